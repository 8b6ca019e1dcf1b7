"""SQL of what the vector index does, written out round by round, for comparison with its results."""

from __future__ import annotations

import numpy as np

from orrery.operators import ivf

SCORES = {"l2": "-(list_distance({a}, {b}) ** 2)", "dot": "list_inner_product({a}, {b})", "cosine": "list_cosine_similarity({a}, {b})"}


def score(metric: str, a: str, b: str) -> str:
    return SCORES[metric].format(a=a, b=b)


def rows(where: str = "true") -> str:
    return f"e AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE {where})"


def assigned(name: str, source: str, centroids: str, metric: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT vec_id, label, v, c FROM (SELECT x.vec_id, x.label, x.v, y.c,
  row_number() OVER (PARTITION BY x.vec_id ORDER BY round({score(metric, 'x.v', 'y.v')}, 12) DESC, y.c) AS rk FROM {source} x, {centroids} y) WHERE rk = 1)"""


def lloyd(p: str, source: str, metric: str, k: str = "least(greatest(ceil(sqrt(max(n))), 1), 16)", rounds: int = ivf.ROUNDS) -> str:
    """Tables ``{p}c``, the centroids (c, v), after all rounds over ``source``, and ``{p}a``, its rows with theirs."""
    out = [
        f"{p}o AS MATERIALIZED (SELECT vec_id, v, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n FROM {source})",
        f"{p}k AS MATERIALIZED (SELECT ({k})::BIGINT AS k, max(n)::BIGINT AS n FROM {p}o)",
        f"{p}s AS MATERIALIZED (SELECT unnest(range(k)) AS i, k, n FROM {p}k)",
        f"{p}c0 AS MATERIALIZED (SELECT i AS c, v FROM {p}o, {p}s WHERE r = (i * {p}s.n) // k)",
    ]
    for r in range(1, rounds + 1):
        unit = "list_transform(m.v, lambda x: x / sqrt(list_inner_product(m.v, m.v)))" if metric == "cosine" else "m.v"
        out += [
            assigned(f"{p}a{r}", source, f"{p}c{r - 1}", metric),
            f"{p}m{r} AS (SELECT c, list(x ORDER BY d) AS v FROM (SELECT c, d, avg(x) AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM {p}a{r}) GROUP BY c, d) GROUP BY c)",
            f"{p}c{r} AS MATERIALIZED (SELECT o.c, CASE WHEN m.v IS NULL THEN o.v ELSE {unit} END AS v FROM {p}c{r - 1} o LEFT JOIN {p}m{r} m USING (c))",
        ]
    out += [f"{p}c AS MATERIALIZED (SELECT * FROM {p}c{rounds})", assigned(f"{p}a", source, f"{p}c", metric)]
    return ",\n".join(out)


def rebuilt(metric: str, clusters: tuple[int, ...], k: int) -> str:
    """After ``lloyd('', ...)``: tables ``nc`` and ``na`` of an index whose ``clusters`` have become ``k`` new ones."""
    few = ", ".join(map(str, clusters))
    return ",\n".join(
        [
            f"part AS MATERIALIZED (SELECT vec_id, label, v FROM a WHERE c IN ({few}))",
            lloyd("p", "part", metric, str(k)),
            f"old AS MATERIALIZED (SELECT c AS was, row_number() OVER (ORDER BY c) - 1 AS c, v FROM c WHERE c NOT IN ({few}))",
            "nc AS MATERIALIZED (SELECT c, v FROM old UNION ALL SELECT c + (SELECT count(*) FROM old), v FROM pc)",
            "na AS MATERIALIZED (SELECT a.vec_id, a.v, old.c FROM a JOIN old ON a.c = old.was UNION ALL SELECT vec_id, v, c + (SELECT count(*) FROM old) FROM pa)",
        ]
    )


def probes(metric: str, n: int = ivf.PROBES, allowed: str = "true") -> str:
    """Tables ``q``, the query's vector, and ``pr``, the clusters that are searched, with their rank."""
    return f"q AS MATERIALIZED (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), pr AS MATERIALIZED (SELECT c.c, row_number() OVER (ORDER BY round({score(metric, 'q.v', 'c.v')}, 12) DESC, c.c) AS rank FROM c, q WHERE {allowed} QUALIFY rank <= {n})"


_FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform([7, 6, 5, 4, 3, 2, 1, 0], lambda i: ((vec_id::BIGINT >> (8 * i)) & 255)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def sample(n: int = 25, source: str = "embeddings") -> str:
    """Tables up to ``sm``, the ``n`` ids whose mixed key is least."""
    two64 = "18446744073709551616::UHUGEINT"
    mix = lambda x, bits, by: f"(xor({x}, {x} // {1 << bits}::UHUGEINT) * {by}::UHUGEINT) % {two64}"
    return f"""s0 AS (SELECT vec_id, ({_FNV} + {0x9E3779B97F4A7C15}::UHUGEINT) % {two64} AS h FROM {source}),
s1 AS (SELECT vec_id, {mix('h', 30, 0xBF58476D1CE4E5B9)} AS h FROM s0), s2 AS (SELECT vec_id, {mix('h', 27, 0x94D049BB133111EB)} AS h FROM s1),
sm AS MATERIALIZED (SELECT vec_id FROM (SELECT vec_id, xor(h, h // {1 << 31}::UHUGEINT) AS h FROM s2) ORDER BY h, vec_id LIMIT {n})"""


def recall(metric: str, k: int = 10) -> str:
    """After ``lloyd('', ...)`` and ``sample``: for each sample the sizes of both results and what they share."""
    return f"""sq AS MATERIALIZED (SELECT sm.vec_id AS sample_id, e.v FROM sm JOIN e USING (vec_id)),
sp AS MATERIALIZED (SELECT sample_id, c.c FROM sq, c QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY round({score(metric, 'sq.v', 'c.v')}, 12) DESC, c.c) <= {ivf.PROBES}),
ss AS MATERIALIZED (SELECT sample_id, a.vec_id, round({score(metric, 'a.v', 'sq.v')}, 12) AS s, a.c FROM a, sq),
ex AS (SELECT sample_id, vec_id FROM ss QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, vec_id) <= {k}),
an AS (SELECT ss.sample_id, ss.vec_id FROM ss JOIN sp USING (sample_id, c) QUALIFY row_number() OVER (PARTITION BY ss.sample_id ORDER BY s DESC, ss.vec_id) <= {k})
SELECT sample_id, n_exact::INT AS n_exact, n_ann::INT AS n_ann, round(shared::DOUBLE / greatest(1, least({k}, n_exact)), 6) AS recall FROM
(SELECT sample_id, count(*) AS n_exact FROM ex GROUP BY 1) JOIN (SELECT sample_id, count(*) AS n_ann FROM an GROUP BY 1) USING (sample_id)
JOIN (SELECT ex.sample_id, count(an.vec_id) AS shared FROM ex LEFT JOIN an USING (sample_id, vec_id) GROUP BY 1) USING (sample_id)"""


def rotated(vector: str, width: int = 64) -> str:
    """Signs, then the Walsh-Hadamard transform element by element."""
    signs = "[" + ", ".join(f"{int(s)}" for s in ivf._signs(width)) + "]"
    return f"list_transform(range({width}), lambda i: list_sum(list_transform(range({width}), lambda j: (CASE WHEN bit_count((i & j)::BIGINT) % 2 = 0 THEN 1 ELSE -1 END) * ({signs})[j + 1] * ({vector})[j + 1])) / sqrt({width}::DOUBLE))"


def codes(width: int = 64) -> str:
    """After ``lloyd('', ...)`` by L2: table ``co`` of rotated residuals with their bits, lengths and products."""
    difference = "list_transform(range(1, 65), lambda i: a.v[i] - c.v[i])"
    return f"""cr AS MATERIALIZED (SELECT a.vec_id, a.c, {difference} AS d FROM a JOIN c USING (c)),
cy AS MATERIALIZED (SELECT vec_id, c, {rotated('d', width)} AS y FROM cr),
cn AS MATERIALIZED (SELECT vec_id, c, y, list_transform(y, lambda x: CASE WHEN x > 1e-9 THEN 1 ELSE 0 END) AS bits, sqrt(list_inner_product(y, y)) AS norm FROM cy),
co AS MATERIALIZED (SELECT vec_id, c, bits, norm, CASE WHEN norm > 0 THEN list_inner_product(y, list_transform(bits, lambda b: (2 * b - 1)::DOUBLE)) / sqrt({width}::DOUBLE) / norm ELSE 1.0 END AS product FROM cn)"""


CODE = "list_aggregate(list_transform(range(8), lambda i: printf('%02X', list_sum(list_transform(range(8), lambda k: bits[8 * i + k + 1] * (1 << (7 - k))::INT))::INT)), 'string_agg', '')"


def estimates(width: int = 64) -> str:
    """After ``codes``: estimated squared distances from the query and bounds of their error."""
    return f"""q AS MATERIALIZED (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
qr AS MATERIALIZED (SELECT c.c, list_transform(range(1, 65), lambda i: q.v[i] - c.v[i]) AS d FROM c, q),
qy AS MATERIALIZED (SELECT c, {rotated('d', width)} AS y FROM qr),
ql AS MATERIALIZED (SELECT c, y, sqrt(list_inner_product(y, y)) AS len FROM qy)
SELECT co.vec_id, round(norm * norm + len * len - 2 * norm * (list_inner_product(list_transform(bits, lambda b: (2 * b - 1)::DOUBLE), y) / sqrt({width}::DOUBLE) / product), 6) + 0.0 AS estimate,
round(2 * {ivf.EPSILON} * norm * len * sqrt(greatest(1 - product * product, 0)) / product / sqrt({width - 1}::DOUBLE), 6) + 0.0 AS error FROM co JOIN ql USING (c)"""


assert np.abs(ivf._signs(64)).sum() == 64
