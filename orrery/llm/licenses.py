"""License scans by a generalised suffix automaton of licence tokens.

The templates' tokens (lower-case runs of letters, digits and underscores) make up one automaton, of some
thousands of states, which every worker builds for itself.  A file's tokens are streamed through
it: after each, the longest stretch that ends there and occurs in some template is known.  Stretches of at
least ``SHORTEST`` tokens that can't be extended are placed in the templates where they occur, and those of one
template are chained in order of both texts, at most ``GAP`` tokens apart, into a span.  A span is
reported if it covers ``COVERAGE`` of its template; of overlapping spans the one that covers most tokens stays, and of those
the one that covers most of its template, so that a text is named by the template it completes.  Whole licences, their parts (grant, conditions,
disclaimer), file headers, notices and SPDX tags are templates of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from orrery.llm.common import column, spread
from orrery.llm.license_texts import TEXTS

SHORTEST, GAP, COVERAGE = 4, 30, 0.6
_TOKEN = re.compile(r"\w+")
TEMPLATES = TEXTS


class Automaton:
    """Generalised suffix automaton over lists of symbols; knows each state's end places in the lists."""

    def __init__(self, lists: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        self._own = own
        for k, symbols in enumerate(lists):
            last = 0
            for place, c in enumerate(symbols):
                last = self._extend(last, c)
                own[last].append((k, place + 1))
        self.ends: list[list[tuple[int, int]]] = [list(x) for x in own]
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] += self.ends[s]
        self.ends = [sorted(set(x)) for x in self.ends]

    def _new(self, length: int, link: int, next_: dict[int, int]) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self._own.append([])
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def stream(self, symbols: list[int]) -> list[tuple[int, int]]:
        """For every symbol the length of the longest stretch ending there that the lists have, and its state."""
        state, n, out = 0, 0, []
        for c in symbols:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if (q := self.next[state].get(c)) is not None:
                state, n = q, n + 1
            else:
                state, n = 0, 0
            out.append((n, state))
        return out


def chain(matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Of one template's ``(file end, template end, length)`` the best chains, as ``(start, end, covered)`` in the file."""
    matches = sorted(matches)
    best = [n for _, _, n in matches]
    back = [-1] * len(matches)
    for i, (e, t, n) in enumerate(matches):
        for j in range(i - 1, -1, -1):
            e2, t2, n2 = matches[j]
            if e - n - e2 > gap + 500:
                break
            # a match may overlap the one before it; what is new in both texts counts
            new = min(n, e - e2, t - t2)
            if new > 0 and e - n - e2 <= gap and best[j] + new > best[i]:
                best[i], back[i] = best[j] + new, j
    out, used = [], set()
    for i in sorted(range(len(matches)), key=lambda i: (-best[i], i)):
        if i in used:
            continue
        k, path = i, []
        while k >= 0 and k not in used:
            path.append(k)
            k = back[k]
        used.update(path)
        if k < 0:
            first = matches[path[-1]]
            out.append((first[0] - first[2], matches[i][0], best[i]))
    return out


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        split = [_TOKEN.findall(templates[n].lower()) for n in self.names]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for s in split for w in s}))}
        self.sizes = [len(s) for s in split]
        self.automaton = Automaton([[self.ids[w] for w in s] for s in split])

    def scan(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """``(template, first token, end token, tokens covered, share of the template covered)`` in order of place."""
        get = self.ids.get
        codes = np.array([get(w, 0) for w in _TOKEN.findall(text.lower())] or [0], np.int32)
        # no template has other tokens, so the stretches between them are streamed on their own
        edge = np.flatnonzero(np.diff(np.r_[0, codes > 0, 0]))
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < SHORTEST:
                continue
            found = self.automaton.stream(codes[a:b].tolist())
            for i, (n, state) in enumerate(found):
                if n >= SHORTEST and (i + 1 == len(found) or found[i + 1][0] != n + 1):
                    for k, end in self.automaton.ends[state]:
                        by_template.setdefault(k, []).append((a + i + 1, end, n))
        spans = [(k, s, e, c) for k, m in by_template.items() for s, e, c in chain(m, GAP) if c >= COVERAGE * self.sizes[k]]
        kept: list[tuple[int, int, int, int]] = []
        for x in sorted(spans, key=lambda x: (-x[3], -x[3] / self.sizes[x[0]], x[1], x[0])):
            if all(x[2] <= y[1] or y[2] <= x[1] for y in kept):
                kept.append(x)
        return [(self.names[k], s, e, c, round(min(1.0, c / self.sizes[k]), 6)) for k, s, e, c in sorted(kept, key=lambda x: (x[1], x[0]))]


_scanners: dict[tuple, Scanner] = {}


def _scan(templates: dict[str, str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tuple(sorted(templates.items()))
        scanner = _scanners.get(key) or _scanners.setdefault(key, Scanner(templates))
        for batch in batches:
            owner, rows = [], []
            for k, text in enumerate(column(batch, "text")):
                for r in scanner.scan(text) if text else ():
                    owner.append(k)
                    rows.append(r)
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)

    return run


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``(doc_id, license, start_token, end_token, n_covered, coverage)``, one row for each span.

    Null and empty texts and texts without licence passages give no rows, as does an empty table; repeated rows give theirs
    each; a null ``doc_id`` stays null; other columns are not read, whatever their names.  Of spans that tie, the one that begins first stays, then the name that sorts first.
    """
    names = ["doc_id", "license", "start_token", "end_token", "n_covered", "coverage"]
    kinds = [T.StringType(), T.IntegerType(), T.IntegerType(), T.IntegerType(), T.DoubleType()]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, k) for n, k in zip(names[1:], kinds))])
    return spread(docs.select("doc_id", "text")).mapInArrow(_scan(templates, names), schema)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
