"""Byte-level BPE: encoding by a global shuffle of distinct words, decoding, and token counts.

Encoding.  Spark splits every text into pre-tokens, once.  A partition's documents are taken in blocks.  A block keeps the
positions: for each document the numbers of its words, in order.  Its distinct words travel, grouped by hash
bucket, to the task that owns the bucket.  There every distinct word of the corpus is encoded
once, and its ids return to the blocks that asked.  A block then puts the ids of its words
back in the order of their positions.  What is shuffled are the distinct words of blocks,
their ids and the blocks' positions, each compressed, and not one row for every token.

Words and positions leave a task in one shuffle, so a block is never formed twice.  Its name is a digest of both: should a lost executor's task come out
otherwise when it is run again, words and positions that don't belong together are an error and not a wrong result.

Decoding joins ids to the table of token bytes, which has a fixed size, and puts the bytes together.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import PATTERN, TOKENIZER, by_key, load_ranks, quoted, read_bytes, spread

BLOCK_ROWS, BLOCK_BYTES, MOST_BUCKETS = 4000, 16_000_000, 8192
_SPLIT = regex.compile(PATTERN)
_loaded: dict[bytes, dict] = {}
_counts: dict[bytes, dict[str, int]] = {}


def ranks_of(raw: bytes) -> dict[bytes, int]:
    """The token table, read once in a worker."""
    key = hashlib.md5(raw).digest()
    if key not in _loaded:
        _loaded[key] = load_ranks(raw)
    return _loaded[key]


# ---------------------------------------------------------------- pre-tokens


def split_columns(text: Column) -> list[Column]:
    """``words``, the text's pre-tokens; ``odd``, the text where they are left to Python; ``size``, its bytes.

    Spark's own expression splits, but for texts with code points that Java's tables, older than Python's, don't know.
    """
    odd = text.rlike(r"\p{Cn}")
    return [F.when(~odd, F.regexp_extract_all(text, F.lit(f"(?U){PATTERN}"), F.lit(0))).alias("words"), F.when(odd, text).alias("odd"), F.octet_length(text).alias("size")]


def _words(batch: pa.RecordBatch | pa.Table) -> pa.ListArray:
    """Each row's pre-tokens; null for a null text."""
    words, odd = (batch.column(batch.schema.get_field_index(c)) for c in ("words", "odd"))
    if isinstance(words, pa.ChunkedArray):
        words, odd = words.combine_chunks(), odd.combine_chunks()
    if odd.null_count == len(odd):
        return words
    return pa.array([w if o is None else _SPLIT.findall(o) for w, o in zip(words.to_pylist(), odd.to_pylist())], pa.list_(pa.string()))


def _flat(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many words each row has, the number of each word's distinct word, and those."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    return sizes, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


# ---------------------------------------------------------------- token counts


def count_word(word: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of a pre-token: its bytes less the merges made, lowest rank first, leftmost first."""
    n = len(word)
    if n < 2 or word in ranks:
        return min(n, 1)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    left, alive = n, [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue  # one of the pair has been merged since
        after[i], end[i], alive[j] = after[j], stop, False
        left -= 1
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get(word[i : end[after[j]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[j]]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return left


def _count(raw: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(raw)
        known = _counts.setdefault(hashlib.md5(raw).digest(), {})
        for batch in batches:
            words = _words(batch)
            sizes, index, distinct = _flat(words)
            each = np.zeros(len(distinct), np.int64)
            for k, w in enumerate(distinct.to_pylist()):
                if (n := known.get(w)) is None:
                    n = count_word(w.encode(), ranks)
                    if len(w) < 64:
                        if len(known) >= 1_000_000:
                            known.clear()
                        known[w] = n
                each[k] = n
            ends = np.r_[0, np.cumsum(each[index])]
            stops = np.cumsum(sizes)
            n = pa.array(ends[stops] - ends[stops - sizes], mask=np.asarray(pc.is_null(words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, n_tokens)`` for every row, repeated rows and null ids included.

    A null text has a null count, an empty one 0; an empty table gives no rows.  No identifiers are made, nothing is shuffled, and columns
    other than ``doc_id`` and ``text`` are not read.
    """
    raw = read_bytes(tokenizer)
    split = spread(docs.select("doc_id", "text")).select("doc_id", *split_columns(F.col("text")))
    return split.mapInArrow(_count(raw), T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType())]))


# ---------------------------------------------------------------- encoding


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, size = [], 0, 0
    for batch in batches:
        at = 0
        ends = np.cumsum(pc.fill_null(batch.column(batch.schema.get_field_index("size")), 0).to_numpy(), dtype=np.int64)
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            fit = int(np.searchsorted(ends, done + BLOCK_BYTES - size, "right")) - at
            take = min(batch.num_rows - at, BLOCK_ROWS - rows, max(fit, 0 if rows else 1))
            if take:
                held.append(batch.slice(at, take))
                rows, size, at = rows + take, size + int(ends[at + take - 1] - done), at + take
            if rows >= BLOCK_ROWS or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def _press(*parts: np.ndarray | bytes) -> tuple[int, bytes]:
    """Size and compressed bytes of ``parts`` in a row, each after its length."""
    raw = b"".join(len(b).to_bytes(8, "little") + b for b in (p if isinstance(p, bytes) else p.tobytes() for p in parts))
    return len(raw), pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def _unpress(size: int, blob: bytes) -> list[memoryview]:
    raw, at, out = memoryview(pa.decompress(blob, size, "zstd", asbytes=True)), 0, []
    while at < size:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


_SHUFFLED = "slot int, home int, block binary, bucket int, size long, data binary, rows binary"
_NAMES = ["slot", "home", "block", "bucket", "size", "data", "rows"]


def _message(slots: list[int], home: int, block: bytes, buckets: list[int], sizes: list[int], data: list[bytes], rows: bytes | None = None) -> pa.RecordBatch:
    """Parts of a block, each for a task ``slot``; ``home`` is the task that will put the block together."""
    n = len(slots)
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((slots, [home] * n, [block] * n, buckets, sizes, data, [rows] * n), kinds)], names=_NAMES)


def _positions(ranks: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bytes for each word: its rank, or that it is the next of those that occur once, or that its rank stands in the second array."""
    rare = ~single & (ranks >= 65534)
    return np.where(single, 65535, np.where(rare, 65534, ranks)).astype(np.uint16), ranks[rare].astype(np.uint32)


def _ranks(short: np.ndarray, rare: np.ndarray, n_words: int) -> np.ndarray:
    ranks, single = short.astype(np.int64), short == 65535
    ranks[short == 65534] = rare
    ranks[single] = n_words - single.sum() + np.arange(single.sum())
    return ranks


def _ask(buckets: int, keep: list[str]):
    """For each block its positions (bucket -1) and, by bucket, its distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        for k_block, table in enumerate(_blocks(batches)):
            home = ((context.partitionId() if context else 0) + 31 * k_block) % buckets  # blocks go round the tasks
            words = _words(table)
            sizes, index, distinct = _flat(words)
            text = distinct.cast(pa.binary()).to_pylist()
            bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in text), np.int64, len(text))
            # words by frequency; those that occur once come last, in the order in which they occur
            times = np.bincount(index, minlength=len(text))
            frequent = np.argsort(-times, kind="stable")
            rank = np.empty(len(text), np.int64)
            rank[frequent] = np.arange(len(text))
            lengths = np.fromiter(map(len, text), np.int64, len(text))
            ends, stops = np.r_[0, np.cumsum(lengths[index])], np.cumsum(sizes)
            whole = ends[stops] - ends[stops - sizes] == pc.fill_null(table.column("size"), 0).to_numpy()
            size, data = _press(*_positions(rank[index], times[index] == 1), bucket[frequent].astype(np.uint16))
            order = frequent[np.argsort(bucket[frequent], kind="stable")]  # by bucket, then by rank
            split = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = [k for k in range(buckets) if split[k] < split[k + 1]]
            asked = []
            for k in full:
                own = order[split[k] : split[k + 1]]
                asked.append(_press(lengths[own].astype(np.uint32), b"".join([text[i] for i in own.tolist()])))
            body = pa.table([*(table.column(f"k{i}") for i in range(len(keep))), pa.array(sizes, mask=np.asarray(pc.is_null(words))), pa.array(whole)], names=[*(f"k{i}" for i in range(len(keep))), "n", "whole"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(body.combine_chunks())
            rows = sink.getvalue().to_pybytes()
            name = hashlib.md5(b"".join([data, rows, *(d for _, d in asked)])).digest()
            yield _message([home], home, name, [-1], [size], [data], rows)
            if full:
                yield _message(full, home, name, full, [n for n, _ in asked], [d for _, d in asked])

    return run


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: merge the lowest-ranked adjacent pair, leftmost first, until none is left."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 200:
        return _encode_long(word, ranks)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap, for words that would take quadratic time."""
    n = len(word)
    after, before, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        after[i], end[i], alive[j] = after[j], stop, False
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get(word[i : end[after[j]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[j]]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _answer(raw: bytes):
    """Words are answered by their ids, and whether those stand for the word again; positions pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(raw)
        token = {i: t for t, i in ranks.items()}
        known: dict[bytes, tuple[list[int], bool]] = {}  # every distinct word of the task's bucket, encoded once
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                slot, home, block, bucket, size, data = (row.column(k)[0].as_py() for k in range(6))
                if bucket < 0:
                    yield row
                    continue
                lengths, text = _unpress(size, data)
                ends = np.cumsum(np.frombuffer(lengths, np.uint32), dtype=np.int64).tolist()
                ids, n, sound = [], [], []
                for a, b in zip([0, *ends], ends):
                    w = bytes(text[a:b])
                    if (x := known.get(w)) is None:
                        own = encode_word(w, ranks)
                        x = known[w] = (own, b"".join([token[t] for t in own]) == w)
                    ids += x[0]
                    n.append(len(x[0]))
                    sound.append(x[1])
                size, data = _press(np.array(n, np.uint32), np.array(ids, np.uint16 if len(ranks) <= 1 << 16 else np.uint32), np.array(sound, bool))
                yield _message([slot], home, block, [bucket], [size], [data])

    return run


def _assemble(raw: bytes, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.uint16 if len(ranks_of(raw)) <= 1 << 16 else np.uint32
        lost = RuntimeError("encode(): words and positions of a block don't belong together; the input came out otherwise when it was computed again")
        for block in by_key(batches, "block"):
            buckets = block.column("bucket").to_pylist()
            sizes, data = block.column("size").to_pylist(), block.column("data").to_pylist()
            order = sorted(range(len(buckets)), key=lambda i: buckets[i])
            if buckets.count(-1) != 1:
                raise lost
            body = pa.ipc.open_stream(block.column("rows")[order[0]].as_py()).read_all()
            short, rare, bucket = _unpress(sizes[order[0]], data[order[0]])
            bucket = np.frombuffer(bucket, np.uint16)
            codes = _ranks(np.frombuffer(short, np.uint16), np.frombuffer(rare, np.uint32), len(bucket))
            given = [_unpress(sizes[i], data[i]) for i in order[1:]]
            n = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(g[0], np.uint32) for g in given)]).astype(np.int64)
            if len(n) != len(bucket):
                raise lost
            ids = np.concatenate([np.empty(0, width), *(np.frombuffer(g[1], width) for g in given)])
            sound = np.concatenate([np.empty(0, bool), *(np.frombuffer(g[2], bool) for g in given)])
            place = np.empty(len(bucket), np.int64)
            place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))  # of each rank in the answers
            starts = np.cumsum(n) - n
            n, starts, sound = n[place], starts[place], sound[place]
            counts = pc.fill_null(body.column("n"), 0).to_numpy()
            stops = np.cumsum(counts)
            tokens, wrong = np.r_[0, np.cumsum(n[codes])], np.r_[0, np.cumsum(~sound[codes])]
            null = np.asarray(pc.is_null(body.column("n").combine_chunks()))
            good = body.column("whole").to_numpy() & (wrong[stops] == wrong[stops - counts])
            for i in range(0, body.num_rows, 512):
                part = slice(i, i + 512)
                a, b = int(stops[i] - counts[i]), int(stops[part][-1])
                own = codes[a:b]
                at = np.repeat(starts[own] - (tokens[a:b] - tokens[a]), n[own]) + np.arange(tokens[b] - tokens[a])
                offsets = np.r_[tokens[a], tokens[stops[part]]] - tokens[a]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids[at].astype(np.int32)), mask=pa.array(null[part]))
                lengths = pa.array(np.diff(offsets), mask=null[part])
                cols = [body.column(f"k{k}").slice(i, 512).combine_chunks() for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, lists, lengths, pa.array(good[part], mask=null[part])], names=[*keep, "token_ids", "n_tokens", "round_trip"])

    return run


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, keep: tuple[str, ...] = ("doc_id",), buckets: int | None = None) -> DataFrame:
    """The columns ``keep``, ``token_ids``, ``n_tokens``, and ``round_trip``: whether the ids' bytes are those of the text again.

    One row for each row of ``docs``, an empty table gives none.  A null text has nulls, an empty one no ids.  Repeated rows are
    encoded as often as they occur.  Other columns, whatever their names, stay out; ``keep`` may not name one of the results.
    ``buckets`` sets how many tasks share the distinct words, by default as many as a shuffle has partitions.
    """
    if {"token_ids", "n_tokens", "round_trip"} & {c.lower() for c in keep}:
        raise ValueError("a kept column has the name of a result")
    raw, spark = read_bytes(tokenizer), docs.sparkSession
    keep = tuple(dict.fromkeys(c for c in keep if c != "text"))
    buckets = buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    source = spread(docs.select(*map(quoted, keep), "text")).select(*(quoted(c).alias(f"k{i}") for i, c in enumerate(keep)), *split_columns(F.col("text")))
    asked = source.mapInArrow(_ask(buckets, list(keep)), _SHUFFLED)
    answers = asked.repartitionById(buckets, F.col("slot")).mapInArrow(_answer(raw), _SHUFFLED)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return answers.repartitionById(buckets, F.col("home")).sortWithinPartitions("block").mapInArrow(_assemble(raw, list(keep)), schema)


# ---------------------------------------------------------------- decoding


def _decode(raw: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(raw)
        least, most = min(ranks.values(), default=0), max(ranks.values(), default=-1)
        by_id: list[bytes | None] = [None] * (most + 1)
        for t, i in ranks.items():
            by_id[i] = t
        table = pa.array(by_id, pa.large_binary())
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("token_ids"))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            ids = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            there = (ids >= least) & (ids <= most)
            joined = table.take(pa.array(np.where(there, ids, 0), mask=~there)) if len(table) else pa.nulls(len(ids), pa.large_binary())
            gone = np.r_[0, np.cumsum(np.asarray(pc.is_null(joined)))]
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(joined), 0).to_numpy(zero_copy_only=False).astype(np.int64))]
            every = b"".join(joined.drop_null().to_pylist())
            stops = np.cumsum(sizes)
            starts, null = stops - sizes, np.asarray(pc.is_null(lists))
            out = [None if null[i] or gone[b] > gone[a] else every[ends[a] : ends[b]].decode("utf-8", "replace") for i, (a, b) in enumerate(zip(starts.tolist(), stops.tolist()))]
            names = [n for n in batch.schema.names if n != "token_ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(out, pa.string())], names=[*names, "text"])

    return run


def decode(tokens: DataFrame, tokenizer: str = TOKENIZER, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``text``, each id joined to its bytes in the token table, which every worker has whole (it is of a fixed size).

    Null ids, a null among them, or an id the table lacks give a null text; no ids give an empty one;
    bytes that are not UTF-8 are replaced.  Repeated rows stay, an empty table gives no rows, and other columns are not read.
    """
    keep = tuple(c for c in keep if c not in ("text", "token_ids"))
    schema = T.StructType([*(tokens.schema[c] for c in keep), T.StructField("text", T.StringType())])
    return tokens.select(*map(quoted, keep), "token_ids").mapInArrow(_decode(read_bytes(tokenizer)), schema)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: the documents' ids beside their ``doc_id``, ``lang`` and ``source``."""
    return encode(docs, keep=("doc_id", "lang", "source"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids."""
    return decode(op2_bpe(spark, sf_dir))


DECODED_SQL = "SELECT doc_id, text FROM documents"


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
