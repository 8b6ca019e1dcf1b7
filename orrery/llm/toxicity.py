"""Toxicity: non-negative positive-unlabelled learning of linear classifiers in numpy.

Confirmed toxic documents, all of them, are the positives.  The unlabelled text is all labelled documents with their
labels hidden, toxic ones among it as often as they come.  With class prior ``p`` the risk is
``p R+(positives) + max(0, R-(unlabelled) - p R-(positives))``; where the second part falls below zero the step goes up
it instead, which keeps the classifier from learning the positives among the unlabelled as negatives.

Features are parts of words in the whole text, so that a stem counts under any ending: runs of ``SIZES`` bytes, hashed to
``BITS`` bits, each once for occurring and once for occurring again.  Kept are the ``KEEP`` whose share among the positives, one
positive put aside, most exceeds that among the unlabelled.  Weights are drawn to zero, so that long documents don't
add up noise.  The probability is the mean of ``MEMBERS`` classifiers, each trained on its own resample: a text
counts as often as a Poisson variable of mean 1 says, drawn from a hash of the text.

The threshold is that of the least loss on labelled documents held out: they are parted in two by a hash of the text, each half
is scored by classifiers trained on the other, and what is lost of the toxic plus ``STRICT`` times what is lost of the clean is least there.

Training reads every labelled document.  Texts and their features stay with the executors: counts by feature come to the driver, then for each
step the sums over all texts of the gradient at the features kept, and counts of held-out probabilities of six decimals; the ids and labels, 9 bytes each, pass it too.
Scoring reads every text whole and shuffles nothing.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import column, cut, numbered, pieces, splitmix, spread

MEMBERS, THRESHOLD, STRICT = 3, 0.5, 2.0
#: Texts in one block of features; with one block the driver does the steps, with more the executors.
BLOCK = 4096
#: Sizes are at most 7, so that a run and its size fit 64 bits.
SIZES, BITS, LEVELS, KEEP = (5, 6, 7), 18, 2, 2000
_GAP = re.compile(r"\W+")


#: Lower case of the signs of one byte in Latin-1, a blank for those outside words.
_LATIN = bytes(ord(c.lower()) if not _GAP.match(c) else 32 for c in map(chr, range(256)))


def _words(text: str) -> bytes:
    """The text in lower case with blanks for all that isn't in words; how many blanks part two words doesn't matter."""
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").encode()
    except UnicodeEncodeError:
        return _GAP.sub(" ", text.lower()).encode()


def _runs(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """By size, the bucket of every run of bytes that lies in one word and where it starts; where each text starts, and the end.

    A blank before or after the word counts as part of it.  All texts lie in one array, with a blank before each and behind the last.
    """
    each = [_words(t) for t in texts]
    begins = np.cumsum([0, *(len(x) + 1 for x in each)])
    k = int(begins[-1])
    raw = np.frombuffer(b" ".join([b"", *each, bytes(8)]), np.uint8)
    blank = raw == 32
    blank[k:] = True  # no run goes on behind the last text
    inside = np.ones(k, bool)
    at = eight = None
    runs, places, seen = [], [], 1
    for n in SIZES:
        for j in range(seen, n - 1):
            inside &= ~blank[j : j + k]
        seen = n - 1
        if at is None:
            at = np.flatnonzero(inside)
            eight = np.ndarray(k, ">u8", raw, strides=(1,)).astype(np.uint64)[at]
        else:
            on = inside[at]
            at, eight = at[on], eight[on]
        runs.append((splitmix(eight >> np.uint64(64 - 8 * n) | np.uint64(n << 8 * n)) >> np.uint64(64 - BITS)).astype(np.int64))
        places.append(at)
    return runs, places, begins


def _together(texts: list[str], least: int = 100_000) -> Iterator[tuple[int, list[str]]]:
    """The texts in lists of ``least`` signs or a little more, so that arrays over a list are neither short nor large; each with the place of its first."""
    first = signs = 0
    for i, t in enumerate(texts):
        signs += len(t)
        if signs >= least or i == len(texts) - 1:
            yield first, texts[first : i + 1]
            first, signs = i + 1, 0


def _features(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text its distinct features: a bucket plus ``l << BITS`` if it occurs more than ``l`` times."""
    last = np.empty(1 << BITS, np.int32)
    for _, some in _together(texts):
        runs, places, begins = _runs(some)
        parts = [np.searchsorted(at, begins) for at in places]
        for i in range(len(some)):
            rest, found = np.concatenate([x[p[i] : p[i + 1]] for x, p in zip(runs, parts)]), []
            for l in range(LEVELS):
                order = np.arange(len(rest), dtype=np.int32)
                last[rest] = order
                one = last[rest] == order  # of equal buckets the one written last
                found.append(rest[one] + (l << BITS))
                rest = rest[~one]
            yield np.concatenate(found).astype(np.int32)


def _counted(texts: list[str], at: np.ndarray, n_buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For every list of texts the place of its first and how many they are; then, in order, a text's place in the list, one of its buckets as ``at`` numbers them, how often it has it."""
    for first, some in _together(texts):
        runs, places, begins = _runs(some)
        hits = [at[x] for x in runs]
        owner = np.concatenate([np.searchsorted(begins, where[hit >= 0], "right") - 1 for hit, where in zip(hits, places)])
        found, n = np.unique(owner * n_buckets + np.concatenate([hit[hit >= 0] for hit in hits]), return_counts=True)
        yield first, len(some), found // max(n_buckets, 1), found % max(n_buckets, 1), n


@dataclass(frozen=True)
class Model:
    """For every bucket that counts, its weights by level and member; the members' intercepts; from where on a text is toxic."""

    weights: dict[int, tuple[tuple[float, ...], ...]]
    bias: tuple[float, ...]
    threshold: float = THRESHOLD

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.full(1 << BITS, -1, np.int32)
        at[list(self.weights)] = np.arange(len(self.weights))
        return at, np.array(list(self.weights.values())).reshape(-1, LEVELS, len(self.bias))

    def probabilities(self, texts: list[str | None]) -> list[float | None]:
        """That of every text, null for null."""
        at, weights = self._table
        out = []
        for _, size, owner, bucket, n in _counted([t for t in texts if t is not None], at, len(weights)):
            z = np.tile(self.bias, (size, 1))
            for l in range(LEVELS):
                own, by = owner[n > l], weights[bucket[n > l], l]
                z += np.stack([np.bincount(own, by[:, m], size) for m in range(z.shape[1])], 1)
            out += [round(x, 6) for x in (1 / (1 + np.exp(-np.clip(z, -30, 30)))).mean(1).tolist()]
        found = iter(out)
        return [None if t is None else next(found) for t in texts]

    def probability(self, text: str) -> float:
        return self.probabilities([text])[0]

    def toxic(self, text: str | None) -> bool:
        return text is not None and self.probability(text) >= self.threshold


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def _draws(key: np.ndarray, seed: int) -> np.ndarray:
    u = splitmix(key ^ splitmix(np.array([seed], np.uint64))) >> np.uint64(11)
    return np.searchsorted(_POISSON, u * 2.0**-53, side="right").astype(np.float32)


def _by_column(cols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(cols, kind="stable")
    used, starts = np.unique(cols[order], return_index=True)
    return owner[order].astype(np.int32), starts, used


@dataclass(frozen=True)
class Block:
    """Texts with the places of their features; ``label`` is -1 for none; by fit, how often each counts as positive and as unlabelled, drawn and once."""

    fold: np.ndarray
    label: np.ndarray
    cols: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    positive: tuple[np.ndarray, np.ndarray, np.ndarray]
    unlabelled: tuple[np.ndarray, np.ndarray, np.ndarray]
    drawn: np.ndarray
    once: np.ndarray

    @staticmethod
    def of(sets: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, label: np.ndarray, fold: np.ndarray, key: np.ndarray, fits: list[tuple[int, int]]) -> Block:
        """``fits`` are pairs of the fold left out, -1 for none, and a seed."""
        n = np.array([len(x) for x in sets], int)
        cols, owner, rows = np.concatenate([*sets, []]).astype(np.int32), np.repeat(np.arange(len(sets)), n), np.flatnonzero(n)
        once = np.array([[role & (fold != left) for left, _ in fits] for role in (positive, unlabelled)], np.float32)
        drawn = once * np.array([[_draws(key, 2 * seed + role) for _, seed in fits] for role in (0, 1)])
        own = [_by_column(cols[role[owner]], owner[role[owner]]) for role in (positive, unlabelled)]
        return Block(fold, label, cols, (np.cumsum(n) - n)[rows], rows, *own, drawn, once)

    def _down(self, by: tuple[np.ndarray, np.ndarray, np.ndarray], g: np.ndarray, n_features: int) -> np.ndarray:
        """For each fit the sums of ``g`` over the texts that have a feature."""
        owner, starts, used = by
        out = np.zeros((len(g), n_features))
        if len(owner):
            owner = owner.astype(np.intp)
            for own, of in zip(out, g):  # a fit at a time gathers faster than all at once, and "clip", with nothing to clip, faster than looking for places outside
                own[used] = np.add.reduceat(of.take(owner, mode="clip"), starts)
        return out

    def logits(self, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        z = np.repeat(b[:, None], len(self.fold), 1)
        if len(self.rows):
            cols = self.cols.astype(np.intp)
            for own, of in zip(z, w):
                own[self.rows] += np.add.reduceat(of.take(cols, mode="clip"), self.starts)
        return z

    def totals(self, n_features: int) -> list[np.ndarray]:
        """How much counts as positive and as unlabelled, and of the positive what has each feature, as drawn and once."""
        return [np.stack([x.sum(2) for x in (self.drawn, self.once)]), np.stack([self._down(self.positive, x[0], n_features) for x in (self.drawn, self.once)])]

    def sums(self, w: np.ndarray, b: np.ndarray, plain: np.ndarray) -> list[np.ndarray]:
        """Of positive and unlabelled text by fit: the losses as clean, the probabilities, and those by feature."""
        z = self.logits(w, b)
        p, minus = 1 / (1 + np.exp(-np.clip(z, -30, 30))), np.logaddexp(0, z)
        weight = np.where(plain[None, :, None], self.once, self.drawn)
        g = weight * p
        return [(weight * minus).sum(2), g.sum(2), np.stack([self._down(by, x, w.shape[1]) for by, x in zip((self.positive, self.unlabelled), g)])]

    def held(self, w: np.ndarray, b: np.ndarray, left: np.ndarray) -> list[Counter]:
        """How many clean and toxic texts have the probability, in millionths, that the fits which left them out give; a million and one more for the toxic."""
        p = 1 / (1 + np.exp(-np.clip(self.logits(w, b), -30, 30)))
        out = Counter()
        for f in np.unique(left[left >= 0]):
            of = (self.fold == f) & (self.label >= 0)
            out.update((np.rint(p[left == f][:, of].mean(0) * 1e6).astype(int) + (self.label[of] > 0) * 1_000_001).tolist())
        return [out]


def _added(parts: Iterable[list[np.ndarray]]) -> list[np.ndarray]:
    return reduce(lambda a, b: [x + y for x, y in zip(a, b)], parts)


#: Calls a method of every block and adds up what they give.
Over = Callable[..., list[np.ndarray]]


def _over(blocks: list[Block]) -> Over:
    return lambda name, *args: _added(getattr(x, name)(*args) for x in blocks)


def _learn(over: Over, allowed: np.ndarray, prior: float, epochs: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of every fit; ``allowed`` tells the features of each."""
    total, having = over("totals", allowed.shape[1])
    plain = (total[0] == 0).any(0)  # nothing drawn: every text once
    total, having = np.where(plain, total[1], total[0]), np.where(plain[:, None], having[1], having[0])
    n_pos, n_unl = total
    w, b = np.zeros(allowed.shape), np.full(len(allowed), -1.0)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    rate, shrink = 0.1, 0.0005
    for t in range(1, epochs + 1):
        minus, p, by = over("sums", w, b, plain)
        up = minus[1] / n_unl - prior * minus[0] / n_pos >= 0
        gw = np.where(up[:, None], by[1] / n_unl[:, None] - prior * having / n_pos[:, None], prior * by[0] / n_pos[:, None] - by[1] / n_unl[:, None]) * allowed
        gb = np.where(up, p[1] / n_unl - prior, prior * p[0] / n_pos - p[1] / n_unl)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-3)
        w = w - step * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - step * shrink, 0)
        b = b - rate * mb / (1 - 0.9**t) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-3)
    return w, b


def _choose(seen_p: np.ndarray, seen_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Features whose share among the positives, one of them put aside, exceeds that among the unlabelled by most standard errors, two at least."""
    share = (seen_p + seen_u) / (n_p + n_u)
    excess = (np.maximum(seen_p - 1, 0) / n_p - seen_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    best = np.argsort(-excess, kind="stable")[:KEEP]
    return np.sort(best[excess[best] > 2])


def _model(w: np.ndarray, b: np.ndarray, chosen: np.ndarray, threshold: float = THRESHOLD) -> Model:
    weights = np.zeros((LEVELS << BITS, len(b)))
    weights[chosen] = np.round(w.T, 6)
    by_level = weights.reshape(LEVELS, 1 << BITS, len(b))
    used = np.flatnonzero((np.abs(by_level) > 1e-4).any((0, 2)))
    return Model({int(i): tuple(tuple(map(float, by_level[l, i])) for l in range(LEVELS)) for i in used}, tuple(round(float(x), 6) for x in b), threshold)


def _nothing(members: int) -> Model:
    return Model({}, (-30.0,) * members)


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    seen = np.zeros(LEVELS << BITS, np.int64)
    for x in sets:
        seen[x] += 1
    return seen


def _placed(sets: list[np.ndarray], chosen: np.ndarray) -> list[np.ndarray]:
    at = np.full(LEVELS << BITS, -1)
    at[chosen] = np.arange(len(chosen))
    return [at[x][at[x] >= 0] for x in sets]


def fit(positive: list[str], unlabelled: list[str], prior: float, members: int = MEMBERS, seed: int = 0) -> Model:
    """A model from texts.  With no positives, no unlabelled text or no feature that tells them apart it finds nothing toxic."""
    if not positive or not unlabelled:
        return _nothing(members)
    pos, unl = ([np.sort(x) for x in _features(sorted(set(texts)))] for texts in (positive, unlabelled))
    chosen = _choose(_counts(pos), _counts(unl), len(pos), len(unl))
    if not len(chosen):
        return _nothing(members)
    sets = _placed(pos + unl, chosen)
    is_pos, none = np.arange(len(sets)) < len(pos), np.full(len(sets), -1)
    block = Block.of(sets, is_pos, ~is_pos, none, none + 1, splitmix(np.arange(len(sets), dtype=np.uint64)), [(-1, seed + k) for k in range(members)])
    return _model(*_learn(_over([block]), np.ones((members, len(chosen)), bool), prior), chosen)


def least_loss(toxic: np.ndarray, clean: np.ndarray, strict: float = STRICT, n_toxic: np.ndarray | None = None, n_clean: np.ndarray | None = None) -> float:
    """The threshold at which the share of ``toxic`` scores below plus ``strict`` times that of ``clean`` scores from there on is least, the
    middle between the two scores next to it; ``THRESHOLD`` where either is empty.  ``n_toxic`` and ``n_clean`` tell how often each score occurs."""
    if not len(toxic) or not len(clean):
        return THRESHOLD
    cuts = np.unique(np.r_[toxic, clean, 1.0])

    def below(scores: np.ndarray, n: np.ndarray | None) -> np.ndarray:
        order = np.argsort(scores)
        sums = np.r_[0, np.cumsum(np.ones(len(scores)) if n is None else n[order])]
        return sums[np.searchsorted(scores[order], cuts)] / sums[-1]

    loss = below(toxic, n_toxic) + strict * (1 - below(clean, n_clean))
    k = int(np.flatnonzero(loss <= loss.min() + 1e-12)[-1])
    return round(float((cuts[k] + cuts[k - 1]) / 2 if k else cuts[k]), 6)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's texts: by fold and kind, unlabelled (all of them) or positive, how many have each feature; -1 stands for the texts themselves."""
    seen, texts = np.zeros((4, LEVELS << BITS), np.int64), np.zeros(4, np.int64)
    for batch in pieces(batches):
        for own, fold, toxic in zip(_features(column(batch, "text")), column(batch, "fold"), column(batch, "toxic")):
            for kind in (2 * fold, 2 * fold + 1)[: 2 if toxic else 1]:
                seen[kind][own] += 1
                texts[kind] += 1
    for k in range(4):
        at = np.flatnonzero(seen[k])
        for i in range(0, len(at) + 1, 100_000):
            part = np.r_[at[i : i + 100_000], [-1] if i == 0 else []].astype(np.int64)
            n = np.where(part >= 0, seen[k][part], texts[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(part), pa.array(n)], names=["kind", "feature", "n"])


def _keep(chosen: np.ndarray):
    """The places in ``chosen``, which is in order, of the features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = np.unique(chosen & ((1 << BITS) - 1))
        at = np.full(1 << BITS, -1, np.int32)
        at[buckets] = np.arange(len(buckets))
        place = np.full((LEVELS, len(buckets)), -1)
        place[chosen >> BITS, at[chosen & ((1 << BITS) - 1)]] = np.arange(len(chosen))
        for batch in pieces(batches):
            each = []
            for first, _, owner, bucket, n in _counted(column(batch, "text"), at, len(buckets)):
                own = np.concatenate([owner[n > l] for l in range(LEVELS)]) + first
                found = np.concatenate([place[l][bucket[n > l]] for l in range(LEVELS)])
                order = np.argsort(own, kind="stable")
                each.append((own[order][found[order] >= 0], found[order][found[order] >= 0]))
            own, found = (np.concatenate(x) for x in zip(*each))
            ends = np.cumsum(np.bincount(own, minlength=batch.num_rows))
            features = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("key", "fold", "toxic")), features], names=["key", "fold", "toxic", "features"])

    return run


def _blocks(fits: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, BLOCK):
            key, fold, label = (np.array([-1 if x is None else x for x in column(batch, c)], np.int64) for c in ("key", "fold", "toxic"))
            sets = [np.array(x, np.int32) for x in column(batch, "features")]
            block = Block.of(sets, label > 0, np.ones(len(sets), bool), label, fold, key.view(np.uint64), fits)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    return run


def _labelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``text`` and ``toxic`` of the documents that have marks.

    Whole numbers go to every worker as an array, 9 bytes for each labelled document, so that no text is shuffled for the join.
    """
    if not all(isinstance(df.schema["doc_id"].dataType, T.IntegralType) for df in (docs, marks)):
        return docs.join(marks, "doc_id").select("text", "toxic")
    table = marks.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("toxic", F.lit(-1)).cast("byte").alias("toxic")).orderBy("doc_id").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("doc_id", "toxic")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, toxic = sent.value
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
            hit = ids[at] == own if len(ids) else np.zeros(len(own), bool)
            mark = toxic[at[hit]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("text")).filter(pa.array(hit)), pa.array(mark, mask=mark < 0)], names=["text", "toxic"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "text string, toxic int")


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, strict: float = STRICT) -> Model:
    """Train on every labelled document.

    ``prior`` is the share of toxic documents; by default the share among the labels that aren't null.
    Rows with null ids or texts are left out; a document labelled twice is toxic if one label says so; equal texts count once, as toxic if one is.
    Labels that tell nothing apart, none at all among them, give a model that finds nothing toxic.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = marks.agg(F.avg("toxic")).first()[0] if prior is None else prior
    prior = min(max(float(share or 0.01), 0.001), 0.9)
    rows = _labelled(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"), marks)
    key = F.xxhash64("text")
    texts_of = cut(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("key", key).withColumn("fold", F.pmod(key, F.lit(2)).cast("int")))
    texts_of = spread(texts_of)
    tally = texts_of.mapInArrow(_tally, "kind int, feature long, n long").groupBy("kind", "feature").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each kind and bucket
    kinds, features, n = (tally.column(c).to_numpy() for c in ("kind", "feature", "n"))
    seen, texts = np.zeros((2, 2, LEVELS << BITS), np.int64), np.zeros((2, 2), np.int64)
    real = features >= 0
    seen[kinds[real] // 2, kinds[real] % 2, features[real]] = n[real]
    texts[kinds[~real] // 2, kinds[~real] % 2] = n[~real]
    total, sizes = seen.sum(0), texts.sum(0)
    if not sizes.all():
        return _nothing(MEMBERS)
    chosen = _choose(total[1], total[0], *sizes[::-1])
    if not len(chosen):
        return _nothing(MEMBERS)
    folds = {f: _choose(seen[1 - f, 1], seen[1 - f, 0], texts[1 - f, 1], texts[1 - f, 0]) for f in (0, 1) if texts[1 - f].all()}
    every = np.unique(np.concatenate([chosen, *folds.values()]))
    fits = [(-1, k) for k in range(MEMBERS)] + [(f, 100 * (f + 1) + k) for f in folds for k in range(MEMBERS)]
    left = np.array([f for f, _ in fits])
    allowed = np.array([np.isin(every, chosen if f < 0 else folds[f]) for f in left])
    kept = cut(texts_of.mapInArrow(_keep(every), "key long, fold int, toxic int, features array<int>"))
    tasks = max(1, min(-(-int(sizes[0]) // BLOCK), docs.sparkSession.sparkContext.defaultParallelism))
    blocks = kept.repartition(tasks, "key").sortWithinPartitions("key", "toxic").mapInArrow(_blocks(fits), "block binary").rdd.map(lambda r: bytes(r.block))
    if sizes[0] <= BLOCK:
        over, stored = _over([pickle.loads(x) for x in blocks.collect()]), None
    else:
        stored = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        over = _over_executors(stored)
    try:
        w, b = _learn(over, allowed, prior)
        held = over("held", w, b, left)[0]
    finally:
        if stored is not None:
            stored.unpersist()
    of, n = np.array(sorted(held), int), np.array([held[x] for x in sorted(held)], int)
    toxic = of > 1_000_000
    threshold = least_loss((of[toxic] - 1_000_001) / 1e6, of[~toxic] / 1e6, strict, n[toxic], n[~toxic])
    return _model(w[:MEMBERS, allowed[0]], b[:MEMBERS], chosen, threshold)


def _over_executors(blocks) -> Over:
    def over(name: str, *args) -> list[np.ndarray]:
        """Every task sends one sum."""
        sent = blocks.context.broadcast(args)

        def run(part: Iterator[bytes]) -> Iterator[list[np.ndarray]]:
            found = [_added(getattr(pickle.loads(x), name)(*sent.value) for x in [first, *part]) for first in [next(part, None)] if first is not None]
            yield from ([x.astype(np.float32) if name == "sums" and x.ndim == 3 else x for x in f] for f in found)

        try:
            return _added(blocks.mapPartitions(run).collect())
        finally:
            sent.destroy()

    return over


def _score(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            p = model.probabilities(column(batch, "text"))
            toxic = [x is not None and x >= threshold for x in p]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(p, pa.float64()), pa.array(toxic, pa.bool_())], names=["doc_id", "p_toxic", "toxic"])

    return run


def score(docs: DataFrame, model: Model, threshold: float | None = None) -> DataFrame:
    """``doc_id``, ``p_toxic`` and ``toxic`` for every row.

    A null text has a null probability and isn't toxic; an empty one has that of the intercepts.  Repeated rows and null ids are scored
    like any other, a probability equal to the threshold is toxic, and an empty table gives no rows.  Other columns are not read, whatever their names.
    """
    kind = T.StructType([docs.schema["doc_id"], T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())])
    return spread(docs.select("doc_id", "text")).mapInArrow(_score(model, model.threshold if threshold is None else threshold), kind)


def _reject(model: Model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            yield batch.filter(pa.array([p is None or p < model.threshold for p in model.probabilities(column(batch, text))], pa.bool_()))

    return run


def reject_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs``, every column and row of it, without those found toxic.

    Null and empty texts, null ids and repeated rows stay as they are unless their text is toxic; without labels nothing is.
    """
    plain = numbered(docs)
    kept = plain.mapInArrow(_reject(train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), f"c{docs.columns.index('text')}"), plain.schema)
    return kept.toDF(*docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
