"""Repeated passages across documents, by a run-length index of their neighbourhoods.

A passage is ``WINDOW`` words (maximal runs of what isn't ASCII white space).  A window is repeated if the
same words occur at another place of the corpus; of a repeated window's places the first, by
(``doc_id``, place), stays and the others are marked.

*Meeting.*  Every window has a minimiser: of its ``WINDOW - GRAM + 1`` runs of ``GRAM`` words, the first of those with
the least hash.  It depends on the window's words alone, so equal windows have equal minimisers.
Minimisers that occur once in the corpus can't be in a repeated window; those that occur
more often send the words of the windows that they stand for to the task that owns the hash.

*Hot hashes.*  A minimiser of more than ``HOT`` places, such as one of boilerplate that many documents have, is split by a longer gram, the window
itself: each of its windows is known by 128 bits of its words, and every class of windows gets its first place by an aggregate that combines before
it shuffles.  No task holds the places of such a hash, and what is marked is the same.

*Index.*  A task sets up, over the distinct neighbourhoods of a range of hashes, the suffix order and its
Burrows-Wheeler transform, and keeps of them the runs only: for each run the symbol, and the
samples of the suffix order at the run's start and at the end of the run before it.  Those
samples give, for each place of the text, the place of the suffix before it in the order, and the length
that both have in common falls by one with each step until the next sample (so it is measured
at samples only).  The matching statistics are streamed from that, place by place.  Windows
whose statistics reach ``WINDOW`` are chained to equal windows, and every class keeps its first place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import column, digest, fresh, hash_words, numbered, pieces, quoted, splitmix, spread, whole_ids

WINDOW, GRAM = 50, 8
#: Words after which a task closes a range of hashes; places above which a hash is split by windows.
RANGE_WORDS, HOT = 250_000, 4096
_PIECE = 1 << 19
_PLACES = re.compile(rb"\S+")


def minimisers(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one document's word hashes: the hash of each minimiser and the first and last window that it stands for."""
    n = len(hashes)
    if n < window:
        return np.empty(0, np.uint64), np.empty(0, int), np.empty(0, int)
    if n > _PIECE:  # each window lies in exactly one piece
        parts = [(i, minimisers(hashes[i : i + _PIECE], window, gram)) for i in range(0, n - window + 1, _PIECE - window + 1)]
        return tuple(np.concatenate(x) for x in zip(*((h, a + i, b + i) for i, (h, a, b) in parts)))
    grams = hashes[: n - gram + 1].copy()
    with np.errstate(over="ignore"):
        for j in range(1, gram):
            grams *= np.uint64(0x9E3779B97F4A7C15)
            grams += hashes[j : n - gram + 1 + j]
        grams = splitmix(grams)
    # the hash's upper bits, then the place: the first of equal ones is the least
    low = (grams & ~np.uint64(0xFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    width, span = window - gram + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    place = (low & np.uint64(0xFFFFF)).astype(int)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return grams[place[first]], first, np.r_[first[1:], len(place)] - 1


def _minimise(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128):
            split = [t.encode().split() for t in column(batch, "text")]
            index, distinct, _ = hash_words([w for s in split for w in s])
            all_, at, out = distinct[index] if len(distinct) else np.empty(0, np.uint64), 0, []
            for s in split:
                out.append(minimisers(all_[at : at + len(s)], window, gram))
                at += len(s)
            h, a, b = (np.concatenate(x) for x in zip(*out))
            take = pa.array(np.repeat(np.arange(len(out)), [len(x) for x, _, _ in out]))
            owner = [batch.column(batch.schema.get_field_index(c)).take(take) for c in ("dg", "doc_id")]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *owner, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["h", "dg", "doc_id", "a", "b"])

    return run


def _neighbourhoods(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128):
            h, a, words, owner = [], [], [], []
            for k, (text, spans) in enumerate(zip(column(batch, "text"), column(batch, "spans"))):
                split = text.encode().split()
                for s in spans:
                    h.append(s["h"])
                    a.append(s["a"])
                    owner.append(k)
                    words.append(b" ".join(split[s["a"] : s["b"] + window]))
            take = pa.array(owner, pa.int64())
            cols = [batch.column(batch.schema.get_field_index(c)).take(take) for c in ("dg", "rep")]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), *cols, pa.array(a, pa.int32()), pa.array(words, pa.binary())], names=["h", "dg", "rep", "a", "words"])

    return run


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' order and its inverse, by doubling; suffixes differ within ``depth`` symbols."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    span = 1
    while True:
        key = rank * (n + 1)
        key[: n - span] += rank[span:] + 1
        order = np.argsort(key, kind="stable")
        steps = np.r_[0, key[order[1:]] != key[order[:-1]]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(steps)
        span *= 2
        if rank[order[-1]] == n - 1 or span >= 2 * depth:
            return order, rank


class RunLengthIndex:
    """The runs of the transform of ``text``, with the samples at their ends.

    ``text`` holds pieces, each closed by a symbol that occurs nowhere else.
    """

    def __init__(self, text: np.ndarray, longest: int):
        order, rank = suffix_order(text, longest + 2)
        bwt = text[order - 1]
        starts = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        self.n = len(text)
        self.symbols, self.starts = bwt[starts], starts
        # samples by place: the suffix at a run's start, and the one before it (the end of the run before)
        first, before = order[starts], np.where(starts > 0, order[starts - 1], -1)
        by_place = np.argsort(first)
        self.sample, self.before = first[by_place], before[by_place]
        self.common = self._common(text)

    def _common(self, text: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at the samples share with those before them."""
        a, b = self.sample.copy(), self.before.copy()
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(b >= 0)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            ok = (x < self.n) & (y < self.n)
            ok[ok] = text[x[ok]] == text[y[ok]]
            live = live[ok]
            out[live] += 1
        return out

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every place of the text the suffix before it in the order (-1: none), and the length in common."""
        which = np.repeat(np.arange(len(self.sample)), np.diff(np.r_[self.sample, self.n]))
        ahead = np.arange(self.n) - self.sample[which]
        return np.where(self.before[which] >= 0, self.before[which] + ahead, -1), np.maximum(self.common[which] - ahead, 0)


def window_classes(pieces_: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each piece's windows the number of their class: two are equal exactly if their words are."""
    top = max(int(p.max()) for p in pieces_) + 1
    text = np.concatenate([x for k, p in enumerate(pieces_) for x in (p, [top + k])]).astype(np.int64)
    before, common = RunLengthIndex(text, max(map(len, pieces_))).statistics()
    link = np.where(common >= window, before, np.arange(len(text)))
    while True:  # every window to the first in the order of those equal to it
        next_ = link[link]
        if (next_ == link).all():
            break
        link = next_
    ends = np.cumsum([len(p) + 1 for p in pieces_])
    return [link[e - len(p) - 1 : e - window] for e, p in zip(ends, pieces_)]


def _mark(window: int):
    def settle(held: dict[bytes, set], names: dict) -> Iterator[pa.RecordBatch]:
        order = {k: i for i, k in enumerate(sorted(names, key=lambda k: (k[0] is None, k[0] or 0, k[1])))}
        texts = list(held)
        split = [t.split() for t in texts]
        flat = hash_words([w for s in split for w in s])[0].astype(np.int64)
        ends = np.cumsum([len(s) for s in split])
        classes = window_classes([flat[e - len(s) : e] for e, s in zip(ends, split)], window)
        where = [np.sort(np.array([order[k] << 32 | a for k, a in held[t]], np.int64)) for t in texts]
        first = np.full(max(int(c.max()) for c in classes) + 1, np.iinfo(np.int64).max)
        for c, w in zip(classes, where):
            np.minimum.at(first, c, w[0] + np.arange(len(c)))
        by_order = list(order)
        out = []
        for c, w in zip(classes, where):
            least = first[c]
            offsets = np.arange(len(c))
            for occurrence in w.tolist():
                marked = least < occurrence + offsets
                if not marked.any():
                    continue
                source = np.where(marked, least >> 32, -1)
                cuts = np.r_[0, np.flatnonzero(source[1:] != source[:-1]) + 1]
                stops = np.r_[cuts[1:], len(c)]
                own, start = by_order[occurrence >> 32], occurrence & 0xFFFFFFFF
                out += [(own[1], own[0], by_order[source[i]][0], start + int(i), start + int(j) - 1 + window) for i, j in zip(cuts, stops) if source[i] >= 0]
        for i in range(0, len(out), 50_000):
            cols = list(zip(*out[i : i + 50_000]))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["dg", "doc_id", "first_doc_id", "start_word", "end_word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, set] = {}
        names: dict = {}
        size, last = 0, None
        for batch in batches:
            for h, dg, rep, a, words in zip(*(column(batch, c) for c in ("h", "dg", "rep", "a", "words"))):
                if h != last and size >= RANGE_WORDS:
                    yield from settle(held, names)
                    held, names, size = {}, {}, 0
                last = h
                if (places := held.get(words)) is None:
                    places = held[words] = set()
                    size += words.count(b" ") + 1
                key = (rep, dg)
                places.add((names.setdefault(key, key), a))
        if held:
            yield from settle(held, names)

    return run


def _windows(window: int):
    """Each window of the spans by 128 bits of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 16):
            keys, a, owner = [b""], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
            for k, (text, spans) in enumerate(zip(column(batch, "text"), column(batch, "spans"))):
                raw = text.encode()
                ends = [m.span() for m in _PLACES.finditer(raw)]
                for s in spans:
                    places = np.arange(s["a"], s["b"] + 1, dtype=np.int32)
                    # words parted by one blank, so that windows of the same words are the same bytes
                    words = [raw[x:y] for x, y in ends[s["a"] : s["b"] + window]]
                    keys += [xxhash.xxh3_128_digest(b" ".join(words[i : i + window])) for i in range(len(places))]
                    a.append(places)
                    owner.append(np.full(len(places), k))
            take = pa.array(np.concatenate(owner))
            cols = [batch.column(batch.schema.get_field_index(c)).take(take) for c in ("dg", "rep")]
            yield pa.RecordBatch.from_arrays([pa.array(keys[1:], pa.binary()), *cols, pa.array(np.concatenate(a))], names=["w", "dg", "rep", "a"])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``(dg, doc_id, first_doc_id, start_word, end_word)`` for the distinct texts: marked spans, not yet merged."""
    assert 0 < gram <= window
    base = spread(docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("dg", digest("text"))
    places = base.mapInArrow(_minimise(window, gram), "h long, dg binary, doc_id long, a int, b int")
    # exact copies have equal places and count once; one shuffle by hash serves both steps
    distinct = places.repartition("h").groupBy("h", "dg", "a", "b").agg(F.min("doc_id").alias("rep"))
    often = distinct.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("n > 1")

    def joined(some: DataFrame) -> DataFrame:
        spans = some.groupBy(F.col("dg").alias("span_dg")).agg(F.min("rep").alias("rep"), F.collect_list(F.struct("h", "a", "b")).alias("spans"))
        return base.join(spans, (base["dg"] == spans["span_dg"]) & base["doc_id"].eqNullSafe(spans["rep"])).select("dg", "rep", "text", "spans")

    near = joined(often.where(F.col("n") <= hot)).mapInArrow(_neighbourhoods(window), "h long, dg binary, rep long, a int, words binary")
    cold = near.repartition("h").sortWithinPartitions("h").mapInArrow(_mark(window), "dg binary, doc_id long, first_doc_id long, start_word int, end_word int")
    windows = joined(often.where(F.col("n") > hot)).mapInArrow(_windows(window), "w binary, dg binary, rep long, a int")
    place = F.struct(F.col("rep").isNull().alias("null"), "rep", "dg", "a")
    firsts = windows.groupBy("w").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("w").alias("fw"), "first")
    later = windows.join(firsts, windows["w"] == firsts["fw"]).where(place > F.col("first"))
    return cold.union(later.select("dg", F.col("rep").alias("doc_id"), F.col("first.rep").alias("first_doc_id"), F.col("a").alias("start_word"), (F.col("a") + window).alias("end_word")))


def merged(spans: DataFrame, *by: str) -> DataFrame:
    """Overlapping and adjoining spans made one, within ``by``."""
    order = Window.partitionBy(*by).orderBy("start_word", "end_word")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("_new", F.when(reach >= F.col("start_word"), 0).otherwise(1))
    return begun.withColumn("_run", F.sum("_new").over(order)).groupBy(*by, "_run").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("_run")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``(doc_id, start_word, end_word, n_words, first_doc_id)``: the marked passages, end exclusive.

    A document whose whole text an earlier one has is one passage, first in the least ``doc_id`` with that text.  In
    other documents a span holds windows whose first place is in ``first_doc_id`` (which is the document itself for
    passages repeated within it).  Null ids come after all others, and equal ids in the order of their texts' digests;
    repeated rows are one document.  Null texts, and those of fewer than ``window`` words, have none; an empty table gives no rows.
    ``doc_id`` must hold whole numbers; columns other than it and ``text`` are not read.
    """
    whole_ids(docs, "doc_id")
    spans = merged(repeated_spans(docs, window, gram, hot), "dg", "doc_id", "first_doc_id").select("doc_id", "start_word", "end_word", "first_doc_id")
    base = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("dg", digest("text"))
    # only digests under more than one id are of interest, and found without the texts
    copied = base.groupBy("dg").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).where("rep < most OR (rep IS NOT NULL AND nulls > 0)").select(F.col("dg").alias("copy"), "rep")
    sized = base.select("doc_id", "dg", _n_words("text").alias("n_words")).where(F.col("n_words") >= window)
    whole = sized.join(copied, sized["dg"] == copied["copy"]).where("doc_id > rep OR doc_id IS NULL").select("doc_id", "dg", "rep", "n_words").distinct()
    whole = whole.select("doc_id", F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"), F.col("rep").alias("first_doc_id"))
    both = spans.union(whole)
    return both.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")


def _n_words(text: str) -> Column:
    """Runs of what isn't ASCII white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([^ \t\n\r\f\x0B]+)"), F.lit(1)))


def _remove(text_at: int, spans_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            out = []
            for text, spans in zip(batch.column(text_at).to_pylist(), batch.column(spans_at).to_pylist()):
                raw, kept, at = text.encode(), [], 0
                ends = [m.span() for m in _PLACES.finditer(raw)]
                for s in sorted(spans, key=lambda s: s["start_word"]):
                    kept.append(raw[at : ends[s["start_word"]][0]])
                    at = ends[s["end_word"]][0] if s["end_word"] < len(ends) else len(raw)
                out.append(b"".join([*kept, raw[at:]]).decode())
            cols = [pa.array(out, pa.string()) if i == text_at else batch.column(i) for i in range(batch.num_columns) if i != spans_at]
            yield pa.RecordBatch.from_arrays(cols, names=[n for i, n in enumerate(batch.schema.names) if i != spans_at])

    return run


def remove_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs``, every column of it, with every marked passage cut out of its text and ``n_chars`` counted again.

    A document of which only white space is left goes, as does all but the first row of an exact copy of at least ``WINDOW`` words; every
    other document stays with its text as it was, null, empty and short texts among them.  Rows repeated in id and text stay as they are.
    """
    whole_ids(docs, "doc_id")
    key, dg, spans_, copy, rep, most, nulls = fresh(docs.columns, "_key", "_dg", "_spans", "_copy", "_rep", "_most", "_nulls")
    spans = merged(repeated_spans(docs), "dg", "doc_id").groupBy(F.col("dg").alias(dg)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(spans_))
    keyed = docs.withColumn(key, digest("text"))
    # exact copies go whole, as repeats() marks them; only digests that occur under several ids are joined
    copied = keyed.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(copy)).agg(F.min("doc_id").alias(rep), F.max("doc_id").alias(most), F.count_if(F.col("doc_id").isNull()).alias(nulls))
    copied = copied.where((F.col(rep) < F.col(most)) | (F.col(rep).isNotNull() & (F.col(nulls) > 0))).select(copy, rep)
    tagged = keyed.join(copied, keyed[key] == copied[copy], "left")
    later = F.col(rep).isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col(rep)))
    left = tagged.where(F.when(later, _n_words("text") < WINDOW).otherwise(F.lit(True)))
    joined = left.join(spans, left[key] == spans[dg], "left")
    every = list(map(quoted, docs.columns))
    plain = joined.where(F.col(spans_).isNull()).select(*every)
    cut_out = numbered(joined.where(F.col(spans_).isNotNull()).select(*every, spans_))
    n = len(docs.columns)
    touched = cut_out.mapInArrow(_remove(docs.columns.index("text"), n), T.StructType(cut_out.schema.fields[:n])).toDF(*docs.columns).where(r"text RLIKE '[^ \\t\\n\\r\\f\\x0B]'")
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return plain.union(touched)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
