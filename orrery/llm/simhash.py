"""SimHash near-duplicates found by anchor-point covering.

A document's fingerprint has 256 bits: for each bit, the sign of the sum of its distinct
words' random signs, longer words weighing more.  All bits take part in the search, as 16 blocks of 16.  In a block the 4,096
words of the covering code [15, 11] (Hamming) x {0, 1} are the anchors: every value is within covering radius 1 of exactly one of them, its home.
A fingerprint is replicated to all anchors within distance 2 of each block's value (home included, 9 at most).  Pairs within ``threshold``
of 256 bits are near-duplicates; groups are their connected components.

What is found.  Every pair within the threshold.  Two fingerprints at most 47 bits apart differ in at most two bits of some block, as three in each of 16
blocks are 48.  Between two such values lies one that is within 1 of both, and its home is within 2 of both: both were sent there.  Each pair of values at most
two bits apart is dealt to one such anchor, and all rows of the one are compared with all of the other in its group (``pairs_of``).  A greater threshold is an error.

Scale.  Anchors are dealt to groups by ``k`` of their bits, and a fingerprint travels once to every group that has an anchor near it (5 of
the 32 groups of a block at ``k`` = 5, and 7.4 of 2,048 at 11); ``k`` follows the number of distinct fingerprints, so that a group's rows fit a task.  Groups that stay
large at the greatest ``k`` are split: each part has a share of the rows to compare with all.  Inside a group, rows within the threshold of a common
leader are linked to it and not compared among each other, so a cluster of near copies costs its size and not the square of it.  The values two bits apart
are 137 of 65,536, so comparisons between unlike documents grow as 0.017 n^2, divided among all tasks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import by_key, column, components, cut, fresh, hash_words, pieces, quoted, splitmix, spread, whole_ids

BLOCKS, BITS, WORDS = 16, 16, 4
FP = [f"f{k}" for k in range(WORDS)]
THRESHOLD = 47
#: Distinct fingerprints for each group of a block; least and most bits that deal anchors to groups; tasks at least; homes in one part of a group that is larger; comparisons from which leaders are sought, and how many; rows of a leader, fewer of which are few, and after how many such leaders of a group no more are sought.
GROUP_ROWS, LEAST_BITS, MOST_BITS, LEAST_TASKS, PART_HOMES, MANY, LEADERS, LED, FEW = 250_000, 5, 11, 128, 200_000, 4_000_000, 64, 256, 8
#: Comparisons of one value's rows from which they are made as a matrix, and of a group from which leaders are sought; pairs compared at once.
MATRIX, AT_ONCE = 20_000, 1_000_000
_WORD = re.compile(r"\w+")


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of four uint64 for each text; texts without a word get zeros."""
    sets = [sorted(set(_WORD.findall(t.lower()))) for t in texts]
    out = np.zeros((len(texts), WORDS), np.uint64)
    flat = [w for s in sets for w in s]
    if not flat:
        return out
    index, hashes, distinct = hash_words(flat)
    wide = np.stack([splitmix(hashes + np.uint64(k * 0x632BE59BD9B4E019 % 2**64)) for k in range(WORDS)], 1)
    weight = np.fromiter((min(max(len(w) - 3, 0.1), 6) for w in distinct.to_pylist()), np.float32, len(distinct))
    signs = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little").astype(np.float32)
    signs *= 2
    signs -= 1
    signs *= weight[:, None]
    at = 0
    for k, s in enumerate(sets):
        if s:
            total = signs[index[at : at + len(s)]].sum(0)
            out[k] = np.packbits(total > 0, bitorder="little").view(np.uint64)
            at += len(s)
    return out


def _codes() -> np.ndarray:
    """For each 16-bit value the anchors within distance 2, its home first, -1 for none."""
    values = np.arange(1 << BITS, dtype=np.int32)
    low, top = values & 0x7FFF, values & 0x8000
    syndrome = np.zeros_like(values)
    for bit in range(15):
        syndrome ^= np.where(low >> bit & 1, bit + 1, 0).astype(np.int32)
    home = np.where(syndrome > 0, low ^ (1 << np.maximum(syndrome - 1, 0)), low).astype(np.int32)
    near = np.full((1 << BITS, 9), -1, np.int32)
    near[:, 0] = home | top
    near[:, 1] = home | (top ^ 0x8000)  # at most one bit to the home, and the last bit
    for s in range(1, 16):
        of = np.flatnonzero(syndrome == s)
        pairs = [(i, i ^ s) for i in range(1, 16) if i < (i ^ s) <= 15]
        for place, (i, j) in enumerate(pairs):
            near[of, 2 + place] = values[of] ^ (1 << (i - 1)) ^ (1 << (j - 1))
    return near


NEAR = _codes()
_groups: dict[int, np.ndarray] = {}


def groups_of(k: int) -> np.ndarray:
    """For each value the groups, by the low ``k`` bits, in which it has an anchor; -1 for none; that of the home first."""
    if k not in _groups:
        g = np.where(NEAR >= 0, NEAR & ((1 << k) - 1), -1)
        for j in range(1, g.shape[1]):
            g[(g[:, :j] == g[:, j : j + 1]).any(1), j] = -1
        _groups[k] = g
    return _groups[k]


_pairs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def pairs_of(k: int, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of values ``(u, v)`` at most two bits apart that a group, by the low ``k`` bits, compares, in order of ``u``; each pair is in one group, in one order.

    It is the group of one's home, ``u``, where that is within 2 of the other; else that of the home of a value between the two.
    """
    if k not in _pairs:
        u = np.arange(1 << BITS, dtype=np.int32)
        home = NEAR[:, 0]
        found = [(u, u, home)]
        for flip in [1 << i for i in range(BITS)] + [1 << i | 1 << j for i in range(BITS) for j in range(i)]:
            v = u ^ flip
            reach, back = np.bitwise_count(home ^ v) <= 2, np.bitwise_count(home[v] ^ u) <= 2
            first = np.where(reach == back, u < v, reach)
            at = np.where(reach, home, home[u ^ (flip & -flip)])
            found.append((u[first], v[first], at[first]))
        left, right, at = (np.concatenate(c).astype(np.int64) for c in zip(*found))
        at &= (1 << k) - 1
        order = np.argsort(at << 32 | left << 16 | right)
        _pairs[k] = left[order].astype(np.uint16), right[order].astype(np.uint16), np.r_[0, np.cumsum(np.bincount(at, minlength=1 << k))]
    left, right, cuts = _pairs[k]
    return left[cuts[group] : cuts[group + 1]], right[cuts[group] : cuts[group + 1]]


def blocks(fp: np.ndarray) -> np.ndarray:
    """The 16-bit values of each fingerprint."""
    return np.ascontiguousarray(fp).view(np.uint16).reshape(len(fp), BLOCKS).astype(np.int32)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts = column(batch, "text")
        fp = fingerprints(texts)
        wordless = ~fp.any(1)
        for i in np.flatnonzero(wordless):
            fp[i] = np.frombuffer(hashlib.sha256(texts[i].encode()).digest(), np.uint64, WORDS)
        cols = [batch.column(batch.schema.get_field_index("doc_id")), pa.array(~wordless)]
        yield pa.RecordBatch.from_arrays(cols + [pa.array(fp[:, k].view(np.int64)) for k in range(WORDS)], names=["doc_id", "worded", *FP])


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([table.column(table.schema.get_field_index(f)).to_numpy() for f in FP], 1).view(np.uint64)


def _homes(k: int):
    """How many rows have their home in each group of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BLOCKS << k, np.int64)
        for batch in batches:
            keys = (np.arange(BLOCKS) << k) + groups_of(k)[blocks(_matrix(batch)), 0]
            seen += np.bincount(keys.ravel(), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["key", "n"])

    return run


def _replicate(k: int, parts: np.ndarray):
    """Every row to the groups in which it has an anchor, and there to each part; ``own`` in the part that compares it with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2048):
            ids, fp = batch.column(batch.schema.get_field_index("rep")).to_numpy(), _matrix(batch)
            found = groups_of(k)[blocks(fp)]  # rows, blocks, groups
            row, block, place = np.nonzero(found >= 0)
            key = (block << k) + found[row, block, place]
            turn = (splitmix(ids.view(np.uint64)) >> np.uint64(33)).astype(np.int64)[row] % parts[key]
            again = np.repeat(np.arange(len(row)), parts[key])
            part = np.arange(len(again)) - np.repeat(np.cumsum(parts[key]) - parts[key], parts[key])
            row, key, own = row[again], key[again], turn[again] == part
            cols = [pa.array((key * (1 << 20) + part).astype(np.int64)), pa.array(own), pa.array(ids[row])]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(fp[row, j].view(np.int64)) for j in range(WORDS)], names=["key", "own", "rep", *FP])

    return run


def near_pairs(left: np.ndarray, right: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of rows of ``left`` and of ``right`` whose fingerprints are within ``threshold`` bits."""
    a_, b_ = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, 1_000_000 // max(1, len(right)))
    for i in range(0, len(left), step):
        part = left[i : i + step]
        # half of the bits first; no pair within the threshold is above it there
        half = np.bitwise_count(part[:, None, 0] ^ right[None, :, 0]) + np.bitwise_count(part[:, None, 1] ^ right[None, :, 1])
        a, b = np.nonzero(half <= threshold)
        ok = np.bitwise_count(part[a] ^ right[b]).sum(1) <= threshold
        a_.append(a[ok] + i)
        b_.append(b[ok])
    return np.concatenate(a_), np.concatenate(b_)


def linked(fp: np.ndarray, homes: np.ndarray, members: np.ndarray, threshold: int, many: int = MANY, leaders: int = LEADERS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``fp`` within the threshold that join the same rows as all pairs of one of ``homes`` and one of ``members`` do; homes are members."""
    led = np.full(len(fp), -1)
    a, b = [], []
    if len(homes) * len(members) > many:
        for c in range(leaders):
            free = homes[led[homes] < 0]
            if not len(free):
                break
            hit = members[np.bitwise_count(fp[members] ^ fp[free[0]]).sum(1) <= threshold]
            a.append(np.full(len(hit), free[0]))
            b.append(hit)
            led[hit[led[hit] < 0]] = c
    of = led[homes]
    for c in np.unique(of):
        some, others = homes[of == c], members if c < 0 else members[led[members] != c]
        x, y = near_pairs(fp[some], fp[others], threshold)
        a.append(some[x])
        b.append(others[y])
    return np.concatenate(a), np.concatenate(b)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges ``(node, root)`` that join the same nodes as the pairs do, one for each node."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = codes[: len(a)], codes[len(a) :]
    root = np.arange(len(nodes))
    while True:
        old = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if (root == old).all():
            return nodes, nodes[root]


def _led(fp: np.ndarray, value: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its leader's class, -1 for none, and the links to leaders.

    A leader has the value most frequent among rows without one; ``FEW`` leaders of fewer than ``LED`` rows end the search.
    """
    led, few = np.full(len(fp), -1), 0
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for c in range(LEADERS):
        free = np.flatnonzero(led < 0)
        if not len(free) or few == FEW:
            break
        lead = free[np.argmax(value[free] == np.argmax(np.bincount(value[free])))]
        hit = np.flatnonzero(np.bitwise_count(fp ^ fp[lead]).sum(1) <= threshold)
        hit = hit[hit != lead]
        few += len(hit) < LED
        a.append(np.full(len(hit), lead))
        b.append(hit)
        led[lead] = c
        led[hit[led[hit] < 0]] = c
    return led, np.concatenate(a), np.concatenate(b)


def _runs(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``n``."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _across(fp: np.ndarray, value: np.ndarray, homes: np.ndarray, members: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], block: int, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the threshold of one of ``homes`` of a value ``u`` and one of ``members`` of ``v``, for all ``pairs (u, v)``; or pairs that join the same rows."""
    homes, members = (x[np.argsort(value[x], kind="stable")] for x in (homes, members))
    n, m = (np.bincount(value[x], minlength=1 << BITS) for x in (homes, members))
    at_n, at_m = np.cumsum(n) - n, np.cumsum(m) - m
    there = (n[pairs[0]] > 0) & (m[pairs[1]] > 0)
    u, v = (x[there].astype(np.int64) for x in pairs)
    work = np.bincount(u, n[u] * m[v], 1 << BITS)
    matrix = work[u] >= MATRIX
    for one in np.unique(u[matrix]):
        own = homes[at_n[one] : at_n[one] + n[one]]
        others = np.concatenate([members[at_m[x] : at_m[x] + m[x]] for x in v[u == one]])
        yield linked(fp, own, np.union1d(own, others), threshold)
    u, v = u[~matrix], v[~matrix]
    # every home once for each v, then once for each member of it; the words of other blocks first
    words = [(block // 4 + i) % 4 for i in (1, 2)]
    row, to = homes[np.repeat(at_n[u], n[u]) + _runs(n[u])], np.repeat(v, n[u])
    steps = np.cumsum(m[to]) // AT_ONCE
    cuts = np.r_[0, np.flatnonzero(np.diff(steps)) + 1, len(to)]
    for i, j in zip(cuts[:-1], cuts[1:]):
        x, y, many = row[i:j], to[i:j], m[to[i:j]]
        other = members[np.repeat(at_m[y], many) + _runs(many)]
        half = sum(np.bitwise_count(np.repeat(fp[x, w], many) ^ fp[other, w]) for w in words)
        ok = np.flatnonzero(half <= threshold)
        x, y = np.repeat(x, many)[ok], other[ok]
        ok = np.bitwise_count(fp[x] ^ fp[y]).sum(1) <= threshold
        yield x[ok], y[ok]


def compare_group(ids: np.ndarray, own: np.ndarray, fp: np.ndarray, block: int, group: int, k: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest over ``ids``, from comparing the ``own`` rows of each value with all rows of the values that the group pairs with it."""
    mine, led = np.flatnonzero(own), np.full(len(fp), -1)
    value = blocks(fp)[:, block]
    a, b = [], []
    if len(mine) * len(fp) > MATRIX:
        led, x, y = _led(fp, value, threshold)
        a.append(x)
        b.append(y)
    for c in np.unique(led[mine]):
        homes, others = mine[led[mine] == c], np.arange(len(fp)) if c < 0 else np.flatnonzero(led != c)
        if len(homes) * len(others) <= AT_ONCE:  # few enough to compare every two
            x, y = near_pairs(fp[homes], fp[others], threshold)
            found = iter([(homes[x], others[y])])
        else:
            found = _across(fp, value, homes, others, pairs_of(k, group), block, threshold)
        for x, y in found:
            ok = x != y
            a.append(x[ok])
            b.append(y[ok])
            if sum(map(len, a)) > MANY:
                x, y = _forest(np.concatenate(a), np.concatenate(b))
                a, b = [x], [y]
    if not sum(map(len, a)):
        return ids[:0], ids[:0]
    return _forest(ids[np.concatenate(a)], ids[np.concatenate(b)])


def _compare(k: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "key"):
            key = int(table.column("key")[0].as_py()) >> 20
            node, root = compare_group(table.column("rep").to_numpy(), table.column("own").to_numpy(), _matrix(table), key >> k, key & ((1 << k) - 1), k, threshold)
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, group_rows: int = GROUP_ROWS, part_homes: int = PART_HOMES) -> DataFrame:
    """Pairs ``(doc_id, duplicate_of)``: every document that goes, and the one of its group that stays.

    Documents of one fingerprint, exact copies among them, are grouped first; only one of them is
    replicated to the anchors.  The least ``doc_id`` of a group stays.  Rows with a null ``doc_id``
    or null text are in no group.  Texts without a word, the empty one included, resemble only their
    exact copies.  Repeated rows of one ``doc_id`` are one document (where their texts differ it
    stands in each text's group).  ``doc_id`` must hold whole numbers.  Only ``doc_id`` and ``text`` are read, whatever else there is;
    an empty table gives no rows.
    """
    if threshold >= 3 * BLOCKS:
        raise ValueError(f"the search is for pairs at most {3 * BLOCKS - 1} bits apart, not {threshold}")
    whole_ids(docs, "doc_id")
    base = spread(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    prints = cut(base.mapInArrow(_fingerprint, "doc_id long, worded boolean, " + ", ".join(f"{f} long" for f in FP)))
    firsts = cut(prints.groupBy("worded", *FP).agg(F.min("doc_id").alias("rep")))
    equal = prints.join(firsts, ["worded", *FP]).where("doc_id > rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    worded = firsts.where("worded").select("rep", *FP)
    k = min(max(math.ceil(math.log2(max(worded.count(), 1) / group_rows)), LEAST_BITS), MOST_BITS)
    homes = worded.mapInArrow(_homes(k), "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()  # 16 blocks by 2^k groups at most
    parts = np.ones(BLOCKS << k, np.int64)
    for r in homes:
        parts[r.key] = min(-(-r.n // part_homes), 1 << 20)
    copies = worded.mapInArrow(_replicate(k, parts), "key long, own boolean, rep long, " + ", ".join(f"{f} long" for f in FP))
    # tasks follow the groups, of which there are as many for any small corpus: a fingerprint's replicas lie as far apart there as in a large one
    tasks = min(BLOCKS << k, max(LEAST_TASKS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    close = copies.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_compare(k, threshold), "a long, b long")
    found = components(close.union(equal))
    return found.where("node > root").select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs``, every column of it, without the documents that ``near_duplicates`` removes, one row for each ``doc_id`` and text.

    Rows with a null id or text stay, equal ones once.
    """
    (name,) = fresh(docs.columns, "gone")
    gone = near_duplicates(docs).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti").dropDuplicates(["doc_id", "text"]).select(*map(quoted, docs.columns))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
