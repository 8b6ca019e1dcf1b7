"""The registered queries of the engine's own operators, each with the SQL that says the same.

Scores are rounded to 6 places and sums of money to 2; ranked results carry ``rank``; ties go to the lesser id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import ids, text, vectors
from orrery.operators import ivf, mutations, ranking
from orrery.operators.attributes import AttributeIndex
from orrery.operators.filters import And, Eq, Filter, Not, Or, Range, between, compile_filter, eq, gte, present
from orrery.operators.textindex import TextIndex
from orrery.plans import oracles
from orrery.plans.query import Indexes, Query, aggregate, execute, ordered
from orrery.sources.collection import Collection
from orrery.sources.json_rows import documents as json_documents
from orrery.sources.storage import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def define(name: str, sql: str | None, f: Callable[[SparkSession, str], DataFrame]) -> None:
    f.__name__ = name
    query(sql)(f)


def filtered(df: DataFrame, f: Filter) -> DataFrame:
    return df.where(compile_filter(f, df.schema))


def marked(s: SparkSession, d: str) -> DataFrame:
    """Documents with the labels that some of them have."""
    return table(s, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(s, d, "labels"), "doc_id", "left")


def line_arrays(s: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity")))
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(rows.alias("r"))
    return g.select("l_orderkey", F.transform("r", lambda x: x["l_returnflag"]).alias("flags"), F.transform("r", lambda x: x["l_quantity"]).alias("quantities"))


# ---------------------------------------------------------------- scans and filters

define("scan_all", "SELECT doc_id, lang, n_chars FROM documents", lambda s, d: table(s, d, "documents").select("doc_id", "lang", "n_chars"))
define("point_lookup", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 42", lambda s, d: filtered(table(s, d, "documents"), eq("doc_id", 42)).select("doc_id", "lang", "n_chars"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (3, 5, 8, 13, 21, 34, 55, 89, 144)")
def multi_get(s, d):
    ids = s.createDataFrame([(i,) for i in (3, 5, 8, 13, 21, 34, 55, 89, 144)], "doc_id bigint")
    return table(s, d, "documents").join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "lang")


_ARRAYS = "SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag, l_quantity) AS flags, list(l_quantity ORDER BY l_linenumber, l_returnflag, l_quantity) AS quantities FROM lineitem GROUP BY l_orderkey"
_MARKED = "documents LEFT JOIN labels USING (doc_id)"
for _name, _table, _filter, _cols, _from, _where in [
    ("filter_eq_string", "documents", eq("lang", "en"), ["doc_id"], "documents", "lang = 'en'"),
    ("filter_eq_int", "part", eq("p_size", 10), ["p_partkey"], "part", "p_size = 10"),
    ("filter_eq_cross_type", "part", eq("p_size", 10.0), ["p_partkey"], "part", "p_size = 10"),
    ("filter_incomparable", "part", ~eq("p_size", "10"), ["p_partkey"], "part", "true"),
    ("filter_range", "orders", between("o_totalprice", 1000.0, 50000.0), ["o_orderkey"], "orders", "o_totalprice >= 1000 AND o_totalprice < 50000"),
    ("filter_range_open", marked, present("quality"), ["doc_id"], _MARKED, "quality IS NOT NULL"),
    ("filter_and", marked, And((eq("lang", "en"), gte("n_chars", 1000), eq("quality", 1))), ["doc_id"], _MARKED, "lang = 'en' AND n_chars >= 1000 AND quality = 1"),
    ("filter_or", marked, Or((eq("lang", "de"), eq("toxic", 1))), ["doc_id"], _MARKED, "lang = 'de' OR toxic = 1"),
    ("filter_not_missing", marked, Not(eq("quality", 1)), ["doc_id"], _MARKED, "quality IS NULL OR quality <> 1"),
    ("filter_nested", marked, Not(Or((And((eq("lang", "en"), eq("quality", 1))), Range("n_chars", None, (500, False))))), ["doc_id"], _MARKED, "NOT ((lang = 'en' AND coalesce(quality = 1, false)) OR n_chars < 500)"),
    ("filter_empty_or", "documents", Or(()), ["doc_id"], "documents", "false"),
    ("filter_array_contains", line_arrays, eq("flags", "R"), ["l_orderkey"], f"({_ARRAYS})", "list_contains(flags, 'R')"),
    ("filter_array_equals", line_arrays, Eq("flags", ["N", "N"]), ["l_orderkey"], f"({_ARRAYS})", "flags = ['N', 'N']"),
    ("filter_array_range", line_arrays, between("quantities", 4.0, 6.0), ["l_orderkey"], f"({_ARRAYS})", "len(list_filter(quantities, lambda x: x >= 4 AND x < 6)) > 0"),
]:
    define(_name, f"SELECT {', '.join(_cols)} FROM {_from} WHERE {_where}", lambda s, d, t=_table, f=_filter, c=_cols: filtered(t(s, d) if callable(t) else table(s, d, t), f).select(*c))


_built: dict[tuple, object] = {}


def once(s: SparkSession, key: tuple, build: Callable):
    """What ``build`` gives, built once for a session and key: an index lies in the shared folder, and only where it lies is held."""
    key = (s.sparkContext.applicationId, *key)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def attributes(s: SparkSession, d: str) -> AttributeIndex:
    return once(s, ("attributes", d), lambda: AttributeIndex.build(table(s, d, "documents"), "doc_id", ["lang", "source", "n_chars"], work_path(s, "attributes-")))


_POST = "SELECT 'lang' AS \"column\", lang AS value, doc_id FROM documents UNION ALL SELECT 'source', source, doc_id FROM documents UNION ALL SELECT 'n_chars', n_chars::DOUBLE::VARCHAR, doc_id FROM documents"
define("postings_build", f'SELECT "column", value, count(*) AS n_ids, min(doc_id) AS first_id FROM ({_POST}) WHERE value IS NOT NULL AND "column" <> \'n_chars\' GROUP BY 1, 2', lambda s, d: s.read.parquet(attributes(s, d).path).where("column <> 'n_chars'").groupBy("column", F.col("text").alias("value")).agg(F.count(F.lit(1)).alias("n_ids"), F.min("id").alias("first_id")))
define("postings_eq", "SELECT doc_id AS id FROM documents WHERE source = 'src7'", lambda s, d: attributes(s, d).ids_for_eq("source", "src7"))
define("postings_range", "SELECT DISTINCT doc_id AS id FROM documents WHERE n_chars >= 500 AND n_chars < 900", lambda s, d: attributes(s, d).ids_for_range("n_chars", (500, True), (900, False)))
define("postings_all", "SELECT DISTINCT doc_id AS id FROM documents WHERE lang IS NOT NULL", lambda s, d: attributes(s, d).all_ids("lang"))

# ---------------------------------------------------------------- aggregates and order

define("agg_count", "SELECT count(*) AS count FROM lineitem WHERE l_quantity < 10", lambda s, d: aggregate(filtered(table(s, d, "lineitem"), Range("l_quantity", None, (10.0, False))), ("Count",)))
define("agg_sum", "SELECT count(l_quantity) AS sum_l_quantity_values, sum(l_quantity) AS sum_l_quantity FROM lineitem", lambda s, d: aggregate(table(s, d, "lineitem"), (("Sum", "l_quantity"),)))
define("agg_sum_missing", f"SELECT count(quality) AS sum_quality_values, coalesce(sum(quality::DOUBLE), 0.0) AS sum_quality FROM {_MARKED}", lambda s, d: aggregate(marked(s, d), (("Sum", "quality"),)))
define("agg_sum_empty", "SELECT 0::BIGINT AS count, 0::BIGINT AS sum_n_chars_values, 0.0::DOUBLE AS sum_n_chars", lambda s, d: aggregate(filtered(table(s, d, "documents"), eq("lang", "xx")), ("Count", ("Sum", "n_chars"))))
define("agg_multi", "SELECT count(*) AS count, count(n_chars) AS sum_n_chars_values, sum(n_chars::DOUBLE) AS sum_n_chars, count(doc_id) AS sum_doc_id_values, sum(doc_id::DOUBLE) AS sum_doc_id FROM documents WHERE lang = 'en'", lambda s, d: aggregate(filtered(table(s, d, "documents"), eq("lang", "en")), ("Count", ("Sum", "n_chars"), ("Sum", "doc_id"))))


def ranked(df: DataFrame, id_col: str, by: tuple, n: int, *cols: str) -> DataFrame:
    column, down = by
    x = F.col(column or id_col)
    order = [x.desc_nulls_last() if down else x.asc_nulls_last(), F.col(id_col).asc()]
    # n is a limit of at most 10,000 rows
    return ordered(df, id_col, by).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(id_col, *cols, "rank")


define("order_by_id_desc", "SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC)::INT AS rank FROM documents QUALIFY rank <= 100", lambda s, d: ranked(table(s, d, "documents"), "doc_id", (None, True), 100))
define("order_by_attr_asc", f"SELECT doc_id, quality, row_number() OVER (ORDER BY quality ASC NULLS LAST, doc_id)::INT AS rank FROM {_MARKED} QUALIFY rank <= 10000", lambda s, d: ranked(marked(s, d), "doc_id", ("quality", False), 10_000, "quality"))
define("order_by_attr_desc", f"SELECT doc_id, quality, row_number() OVER (ORDER BY quality DESC NULLS LAST, doc_id)::INT AS rank FROM {_MARKED} QUALIFY rank <= 10000", lambda s, d: ranked(marked(s, d), "doc_id", ("quality", True), 10_000, "quality"))
define("limit_default", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10000", lambda s, d: execute(table(s, d, "orders"), "o_orderkey", Query()).rows.select("o_orderkey"))


@query("SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id)::INT AS rank FROM documents WHERE lang = 'en' QUALIFY rank <= 10")
def json_request(s, d):
    q = Query.parse({"filter": {"Eq": {"column": "lang", "value": "en"}}, "order_by": {"target": {"Attribute": "n_chars"}, "direction": "Desc"}, "limit": 10})
    rows = execute(table(s, d, "documents"), "doc_id", q).rows
    return rows.select("doc_id", "n_chars", F.row_number().over(Window.orderBy(F.col("n_chars").desc_nulls_last(), "doc_id")).alias("rank"))


# ---------------------------------------------------------------- text

_TOK = r"list_filter(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+'), lambda t: lower(t)), lambda t: strlen(t) <= 39)"
_TF = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY doc_id, term"
_CONV = "SELECT conv_id, list(text ORDER BY turn, text) AS texts FROM conversations WHERE text IS NOT NULL GROUP BY conv_id"


def threads(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))


def text_index(s: SparkSession, d: str) -> TextIndex:
    return once(s, ("text", d), lambda: TextIndex.build(table(s, d, "documents"), "doc_id", "text", work_path(s, "text-")))


def thread_index(s: SparkSession, d: str) -> TextIndex:
    return once(s, ("threads", d), lambda: TextIndex.build(threads(s, d), "conv_id", "texts", work_path(s, "threads-")))


define("tokenize", f"SELECT doc_id, len({_TOK.format('text')})::INT AS n_tokens, md5(list_aggregate({_TOK.format('text')}, 'string_agg', ' ')) AS digest FROM documents", lambda s, d: table(s, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"), F.md5(F.nullif(F.array_join(text.tokens(F.col("text")), " "), F.lit(""))).alias("digest")))
define("tokenize_array", f"SELECT conv_id, len(flatten(list_transform(texts, lambda x: {_TOK.format('x')})))::INT AS n_tokens FROM ({_CONV})", lambda s, d: (lambda t: t.select("conv_id", F.size(text.column_tokens(t, "texts")).alias("n_tokens")))(threads(s, d)))
define("text_tf", _TF, lambda s, d: text.term_frequencies(table(s, d, "documents"), "doc_id", "text"))
define("text_term_df", f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM ({_TF}) GROUP BY term", lambda s, d: text.term_frequencies(table(s, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n")))
define("text_field_stats", f"SELECT count(*) AS doc_count, sum(n)::BIGINT AS total_len FROM (SELECT len({_TOK.format('text')}) AS n FROM documents) WHERE n > 0", lambda s, d: text.field_stats(table(s, d, "documents"), "text"))
define("text_postings", f"SELECT term, count(*) AS df, max(tf) AS max_tf, min(doc_id) AS first_id FROM ({_TF}) GROUP BY term", lambda s, d: text_index(s, d).blocks.select("term", "max_tf", "n", F.array_min("ids").alias("first")).groupBy("term").agg(F.sum("n").alias("df"), F.max("max_tf").cast("long").alias("max_tf"), F.min("first").alias("first_id")))
define("text_term_stats", f"SELECT term, count(*) AS df, max(tf) AS max_tf FROM ({_TF}) GROUP BY term", lambda s, d: text_index(s, d).term_stats().drop("blocks"))


def bm25_sql(terms: dict[str, int], k1: float = 1.2, b: float = 0.75, k3: float = 8.0, source: str = "SELECT doc_id AS id, {0} AS toks, * FROM documents", where: str = "true") -> str:
    """Ranked by the formula, over a relation of ids and token lists."""
    source = source.replace("{0}", _TOK.format("text"))
    q = ", ".join(f"('{t}', {n}.0)" for t, n in terms.items())
    return f"""WITH docs AS (SELECT * FROM ({source}) WHERE len(toks) > 0),
st AS (SELECT count(*)::DOUBLE AS n, sum(len(toks))::DOUBLE / count(*) AS avgdl FROM docs),
q(term, qtf) AS (VALUES {q}),
tf AS (SELECT id, term, qtf, len(list_filter(toks, lambda x: x = term))::DOUBLE AS tf, len(toks)::DOUBLE AS dl FROM docs, q),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf WHERE tf > 0 GROUP BY term),
sc AS (SELECT id, sum((qtf * ({k3} + 1) / (qtf + {k3})) * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) AS score FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY id),
hits AS (SELECT sc.id, score FROM sc JOIN docs USING (id) WHERE {where})"""


def top_sql(k: int, name: str = "doc_id") -> str:
    return f" SELECT id AS {name}, round(score, 6) + 0.0 AS score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM hits QUALIFY rank <= {k}"


def top_text(df: DataFrame, id_col: str, column: str, q: str, k: int, params: ranking.Bm25 = ranking.Bm25(), keep: Filter | None = None, index: TextIndex | None = None) -> DataFrame:
    return ranking.top(ranking.bm25(df, id_col, column, q, params, keep, index, k), id_col, k).withColumn("score", F.round("score", 6))


for _name, _q, _terms, _k, _params, _keep, _where in [
    ("bm25_single", "attion", {"attion": 1}, 20, {}, None, "true"),
    ("bm25_multi", "attion thing ention", {"attion": 1, "thing": 1, "ention": 1}, 50, {}, None, "true"),
    ("bm25_topk", "the license", {"the": 1, "license": 1}, 10, {}, None, "true"),
    ("bm25_filtered", "attion thing", {"attion": 1, "thing": 1}, 20, {}, And((eq("lang", "en"), gte("n_chars", 500))), "lang = 'en' AND n_chars >= 500"),
    ("bm25_params", "attion thing", {"attion": 1, "thing": 1}, 20, {"k1": 2.0, "b": 0.3, "k3": 2.0}, None, "true"),
    ("bm25_case", "ATTION Thing", {"attion": 1, "thing": 1}, 20, {}, None, "true"),
    ("bm25_repeated_term", "attion attion thing", {"attion": 2, "thing": 1}, 20, {}, None, "true"),
]:
    define(_name, bm25_sql(_terms, **_params, where=_where) + top_sql(_k), lambda s, d, q=_q, k=_k, p=_params, f=_keep: top_text(table(s, d, "documents"), "doc_id", "text", q, k, ranking.Bm25(**p), f, text_index(s, d)))

define("bm25_scan", bm25_sql({"attion": 1, "thing": 1, "ention": 1}) + top_sql(50), lambda s, d: top_text(table(s, d, "documents"), "doc_id", "text", "attion thing ention", 50))
define("bm25_empty", "SELECT doc_id, 0.0::DOUBLE AS score, 1::INT AS rank FROM documents WHERE false", lambda s, d: top_text(table(s, d, "documents"), "doc_id", "text", "!!", 10))
define("bm25_array", bm25_sql({"attion": 1, "thing": 1}, source=f"SELECT conv_id AS id, flatten(list_transform(texts, lambda x: {_TOK.format('x')})) AS toks FROM ({_CONV})") + top_sql(20, "conv_id"), lambda s, d: top_text(threads(s, d), "conv_id", "texts", "attion thing", 20, index=thread_index(s, d)))
define("text_agg", bm25_sql({"attion": 1, "thing": 1}, where="lang = 'en'") + " SELECT count(*) AS count, count(n_chars) AS sum_n_chars_values, coalesce(sum(n_chars::DOUBLE), 0.0) AS sum_n_chars FROM hits JOIN docs USING (id)", lambda s, d: execute(table(s, d, "documents"), "doc_id", Query(filter=eq("lang", "en"), aggregates=("Count", ("Sum", "n_chars")), text={"column": "text", "query": "attion thing", "k": 10}), Indexes(text={"text": text_index(s, d)})).aggregates)


@query(bm25_sql({"attion": 1, "thing": 1}, source="SELECT doc_id AS id, {0} AS toks FROM documents WHERE doc_id % 7 <> 3") + top_sql(20))
def bm25_overlay(s, d):
    """Half of the documents in the base, half in the log, and some of both deleted by it."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    log = docs.where("id % 2 = 1").select(F.lit(1).cast("long").alias("seq"), F.col("id").cast("int").alias("op_idx"), "id", F.lit("upsert").alias("op"), "text", F.array(F.lit("text")).alias("set"))
    gone = docs.where("id % 7 = 3").select(F.lit(2).cast("long").alias("seq"), F.col("id").cast("int").alias("op_idx"), "id", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("text"), F.array().cast("array<string>").alias("set"))
    now = mutations.overlay(docs.where("id % 2 = 0"), log.unionByName(gone), ["text"])
    return top_text(now.withColumnRenamed("id", "doc_id"), "doc_id", "text", "attion thing", 20)


# ---------------------------------------------------------------- vectors


def query_vector(s: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    """One row of the table, the query's parameter."""
    r = table(s, d, "embeddings").where(F.col("vec_id") == vec_id).first()
    return [float(x) for x in r.embedding] if r else [1.0] * 64


_E = "SELECT e.vec_id AS id, e.embedding::DOUBLE[] AS v, (SELECT any_value(embedding)::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS q, * FROM embeddings e"
_SCORES = {"l2": "-(list_distance(v, q) ** 2)", "dot": "list_inner_product(v, q)", "cosine": "list_cosine_similarity(v, q)"}


def knn_sql(metric: str, k: int, source: str = _E, where: str = "true") -> str:
    return f"WITH hits AS (SELECT id, {_SCORES[metric]} AS score FROM ({source}) WHERE {where})" + top_sql(k, "vec_id")


def top_vectors(df: DataFrame, q: list[float], metric: str, k: int, keep: Filter | None = None) -> DataFrame:
    return ranking.top(ranking.knn(df, "vec_id", "embedding", q, metric, keep), "vec_id", k).withColumn("score", F.round("score", 6))


for _name, _metric, _k, _keep, _where in [("knn_l2", "l2", 10, None, "true"), ("knn_dot", "dot", 10, None, "true"), ("knn_cosine", "cosine", 10, None, "true"), ("knn_filtered", "cosine", 10, eq("label", 1), "label = 1"), ("knn_metric_override", "dot", 5, None, "true")]:
    define(_name, knn_sql(_metric, _k, where=_where), lambda s, d, m=_metric, k=_k, f=_keep: top_vectors(table(s, d, "embeddings"), query_vector(s, d), m, k, f))


def docs_vectors(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "n_chars", "text")
    return docs.join(table(s, d, "embeddings"), "vec_id", "left")


define("knn_missing_vector", knn_sql("cosine", 10, source="SELECT e.vec_id AS id, e.embedding::DOUBLE[] AS v, (SELECT any_value(embedding)::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS q, d.* FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id", where="v IS NOT NULL"), lambda s, d: top_vectors(docs_vectors(s, d), query_vector(s, d), "cosine", 10))
define("knn_count_before_presence", "SELECT count(*) AS count FROM documents WHERE lang = 'en'", lambda s, d: execute(docs_vectors(s, d), "vec_id", Query(filter=eq("lang", "en"), aggregates=("Count",), exact_vector={"column": "embedding", "vector": query_vector(s, d), "k": 5})).aggregates)
define("knn_ignores_order_by", knn_sql("cosine", 10), lambda s, d: execute(table(s, d, "embeddings"), "vec_id", Query(order_by=("label", True), exact_vector={"column": "embedding", "vector": query_vector(s, d), "k": 10})).rows.select("vec_id", F.round("score", 6).alias("score"), "rank"))
_UNIT = "v[{0}] / sqrt(list_inner_product(v, v))"
define("vec_normalize", f"SELECT vec_id, {', '.join(f'round({_UNIT.format(i)}, 6) + 0.0 AS x{i}' for i in (1, 2, 64))} FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)", lambda s, d: table(s, d, "embeddings").select("vec_id", vectors.normalize(F.col("embedding")).alias("n")).select("vec_id", *((F.round(F.element_at("n", i), 6) + 0.0).alias(f"x{i}") for i in (1, 2, 64))))

_HYBRID = (
    bm25_sql({"attion": 1, "thing": 1}, where="lang = 'en' AND id IN (SELECT vec_id FROM embeddings)")
    + f""", t AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM hits QUALIFY rank <= 10),
v AS (SELECT x.id, row_number() OVER (ORDER BY {_SCORES['cosine']} DESC, x.id) AS rank FROM ({_E}) x JOIN documents dd ON dd.doc_id = x.id WHERE lang = 'en' QUALIFY rank <= 10)
"""
)


def _hybrid(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = docs_vectors(s, d)
    keep = And((eq("lang", "en"), present("embedding")))
    t = ranking.top(ranking.bm25(docs, "vec_id", "text", "attion thing", keep=keep, index=text_index(s, d)), "vec_id", 10)
    v = ranking.top(ranking.knn(docs, "vec_id", "embedding", query_vector(s, d), "cosine", eq("lang", "en")), "vec_id", 10)
    return t, v


@query(_HYBRID + "SELECT id AS doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM v) GROUP BY id")
def hybrid_rrf(s, d):
    return ranking.rrf(list(_hybrid(s, d)), "vec_id").select(F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_HYBRID + "SELECT 0 AS query_idx, id AS doc_id, rank::INT AS rank FROM t UNION ALL SELECT 1, id, rank::INT FROM v")
def multi_query(s, d):
    parts = [r.select(F.lit(i).alias("query_idx"), F.col("vec_id").alias("doc_id"), "rank") for i, r in enumerate(_hybrid(s, d))]
    return parts[0].union(parts[1])


# ---------------------------------------------------------------- approximate vectors


def build_index(s: SparkSession, d: str, metric: str = "cosine", where: str = "true") -> ivf.Index:
    return ivf.Index.build(table(s, d, "embeddings").where(where), "vec_id", "embedding", work_path(s, "vectors-"), metric)


def index(s: SparkSession, d: str, metric: str = "cosine", where: str = "true") -> ivf.Index:
    return once(s, ("vectors", d, metric, where), lambda: build_index(s, d, metric, where))


def grown(s: SparkSession, d: str) -> ivf.Index:
    """An index over the even ids, to which the odd ones were appended."""
    return once(s, ("grown", d), lambda: index(s, d, "cosine", "vec_id % 2 = 0").append(table(s, d, "embeddings").where("vec_id % 2 = 1"), work_path(s, "vectors-"), 1))


def again(s: SparkSession, d: str) -> ivf.Index:
    """The whole index with its first two clusters built anew."""
    return once(s, ("again", d), lambda: index(s, d).rebuild([0, 1], 2, work_path(s, "vectors-")))


def rounded_scores(scored: DataFrame, k: int) -> DataFrame:
    return ranking.top(scored, "vec_id", k).withColumn("score", F.round("score", 6))


def ann_sql(metric: str, k: int = 10, where: str = "true", allowed: str = "true") -> str:
    """Of the clusters that k-means makes those nearest to the query are searched."""
    return f"WITH {oracles.rows()},\n{oracles.lloyd('', 'e', metric)},\n{oracles.probes(metric, allowed=allowed)},\nhits AS (SELECT vec_id AS id, {oracles.score(metric, 'a.v', 'q.v')} AS score FROM a JOIN pr USING (c), q WHERE {where})" + top_sql(k, "vec_id")


_LABELLED = "c.c IN (SELECT a.c FROM a WHERE label = 1)"
define("ann_cosine", ann_sql("cosine"), lambda s, d: rounded_scores(index(s, d).search(query_vector(s, d)), 10))
define("ann_dot", ann_sql("dot"), lambda s, d: rounded_scores(index(s, d, "dot").search(query_vector(s, d)), 10))
define("ann_filtered", ann_sql("cosine", where="label = 1", allowed=_LABELLED), lambda s, d: rounded_scores(index(s, d).search(query_vector(s, d), keep=eq("label", 1)), 10))
define("ann_all_probes", knn_sql("cosine", 10), lambda s, d: rounded_scores(index(s, d).search(query_vector(s, d), probes=16), 10))
define("ann_probe", f"WITH {oracles.rows()},\n{oracles.lloyd('', 'e', 'cosine')},\n{oracles.probes('cosine')} SELECT rank::INT AS rank, c::INT AS cluster_id FROM pr", lambda s, d: s.createDataFrame(list(enumerate(index(s, d).probe(query_vector(s, d), "cosine", None), 1)), "rank int, cluster_id int"))


def approximate(s: SparkSession, d: str, limit: int | None = None, **more) -> Query:
    return Query(limit=limit, approx_vector={"column": "embedding", "vector": query_vector(s, d), "k": 10, **more})


define("ann_limit_below_k", ann_sql("cosine", 3), lambda s, d: execute(table(s, d, "embeddings"), "vec_id", approximate(s, d, 3), Indexes(vector={"embedding": index(s, d)})).rows.select("vec_id", F.round("score", 6).alias("score"), "rank"))
define("ann_agg_exact", "SELECT count(*) AS count FROM embeddings WHERE label = 1", lambda s, d: execute(table(s, d, "embeddings"), "vec_id", Query(filter=eq("label", 1), aggregates=("Count",), approx_vector={"column": "embedding", "vector": query_vector(s, d), "k": 10}), Indexes(vector={"embedding": index(s, d)})).aggregates)
define("ann_no_index", knn_sql("cosine", 10), lambda s, d: execute(table(s, d, "embeddings"), "vec_id", approximate(s, d)).rows.select("vec_id", F.round("score", 6).alias("score"), "rank"))


@query(f"""WITH {oracles.rows("vec_id % 2 = 0")},
{oracles.lloyd("", "e", "cosine")},
{oracles.probes("cosine")},
every AS (SELECT a.vec_id, a.v FROM a JOIN pr USING (c) WHERE a.vec_id % 6 <> 0 UNION ALL SELECT vec_id, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 5 <> 1),
hits AS (SELECT vec_id AS id, list_cosine_similarity(every.v, q.v) AS score FROM every, q)""" + top_sql(10, "vec_id"))
def ann_overlay(s, d):
    """An index over the even ids; since then the odd ones were written but for some, and every sixth id was deleted."""
    e = table(s, d, "embeddings")
    fresh = e.where("vec_id % 2 = 1 AND vec_id % 5 <> 1")
    gone = e.where("vec_id % 2 = 1 OR vec_id % 6 = 0").select("vec_id")
    return rounded_scores(index(s, d, "cosine", "vec_id % 2 = 0").search(query_vector(s, d), fresh=fresh, gone=gone), 10)


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS version, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE 1 END AS sign FROM embeddings WHERE vec_id % 7 <> 2 OR vec_id % 3 = 0")
def ann_versions(s, d):
    """Every third row was written again with its vector turned round, others deleted: of each row's versions in the index the newest counts."""
    e = table(s, d, "embeddings")
    turned = e.where("vec_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    dead = work_path(s, "touched-")
    e.where("vec_id % 3 = 0 OR vec_id % 7 = 2").select("vec_id").write.parquet(dead)
    i = index(s, d).append(turned, work_path(s, "vectors-"), 1, dead)
    was = e.select("vec_id", F.element_at("embedding", 1).alias("x"))
    return i.rows().join(was, "vec_id").select("vec_id", "version", F.when(F.element_at("embedding", 1) == F.col("x"), 1).otherwise(-1).alias("sign"))


@query(ann_sql("l2"))
def ann_l2_rabitq(s, d):
    return rounded_scores(index(s, d, "l2").search_l2(query_vector(s, d), 10), 10)


_L2 = f"WITH {oracles.rows()},\n{oracles.lloyd('', 'e', 'l2')}"
_COSINE = f"WITH {oracles.rows()},\n{oracles.lloyd('', 'e', 'cosine')}"
define("rabitq_encode", f"{_L2},\n{oracles.codes()} SELECT vec_id, c::INT AS cluster_id, {oracles.CODE} AS code, round(norm, 6) AS norm, round(product, 6) AS product FROM co", lambda s, d: index(s, d, "l2").rows().select("vec_id", "cluster_id", F.hex("code").alias("code"), F.round("norm", 6).alias("norm"), F.round("product", 6).alias("product")))
define("rabitq_estimate", f"{_L2},\n{oracles.codes()},\n{oracles.estimates()}", lambda s, d: (lambda i: ivf.estimate(i.rows(), "vec_id", query_vector(s, d), i.centroids))(index(s, d, "l2")).select("vec_id", (F.round("estimate", 6) + 0.0).alias("estimate"), (F.round("error", 6) + 0.0).alias("error")))
define("ann_recall", f"{_COSINE},\n{oracles.sample()},\n{oracles.recall('cosine')}", lambda s, d: ivf.recall(index(s, d)).withColumn("recall", F.round("recall", 6)))
define("ann_recall_average", f"SELECT round(avg(recall), 6) AS recall, avg(n_exact) AS n_exact, avg(n_ann) AS n_ann, count(*) AS samples FROM ({_COSINE},\n{oracles.sample()},\n{oracles.recall('cosine')})", lambda s, d: ivf.averages(ivf.recall(index(s, d))).withColumn("recall", F.round("recall", 6)))
define("recall_sample", f"WITH {oracles.sample()} SELECT vec_id FROM sm", lambda s, d: ivf.sample(table(s, d, "embeddings"), "vec_id", 25).select("vec_id"))
_PLACED = "SELECT vec_id, c::INT AS cluster_id FROM {0}"
define("ivf_build", f"{_COSINE} {_PLACED.format('a')}", lambda s, d: index(s, d).rows().select("vec_id", "cluster_id"))
define("ivf_centroids", f"{_COSINE} SELECT c::INT AS cluster_id, generate_subscripts(v, 1)::INT AS pos, round(unnest(v), 6) + 0.0 AS x FROM c", lambda s, d: s.createDataFrame([(i, c) for i, c in enumerate(index(s, d).centroids)], "cluster_id int, v array<double>").select("cluster_id", F.posexplode("v").alias("pos", "x")).select("cluster_id", (F.col("pos") + 1).alias("pos"), (F.round("x", 6) + 0.0).alias("x")))
define("ivf_cluster_stats", f"{_COSINE} SELECT c::INT AS cluster_id, count(*) AS n FROM a GROUP BY c", lambda s, d: index(s, d).stats())
define("ivf_append", f"WITH {oracles.rows('vec_id % 2 = 0')},\n{oracles.lloyd('', 'e', 'cosine')},\nodd AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 1),\n{oracles.assigned('oa', 'odd', 'c', 'cosine')} {_PLACED.format('a')} UNION ALL {_PLACED.format('oa')}", lambda s, d: grown(s, d).rows().select("vec_id", "cluster_id"))
define("ivf_version_stats", f"WITH {oracles.rows('vec_id % 2 = 0')},\n{oracles.lloyd('', 'e', 'cosine')},\nodd AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 1),\n{oracles.assigned('oa', 'odd', 'c', 'cosine')} SELECT c::INT AS cluster_id, count(*) AS live, 0::BIGINT AS stale, count(*) FILTER (new) AS appended FROM (SELECT c, false AS new FROM a UNION ALL SELECT c, true FROM oa) GROUP BY c", lambda s, d: grown(s, d).versions())
define("ivf_plan", f"{_COSINE}, n AS (SELECT c::INT AS cluster_id, count(*) AS n FROM a GROUP BY c), t AS (SELECT ceil(sum(n)::DOUBLE / (SELECT count(*) FROM c)) AS t FROM n) SELECT cluster_id, n, CASE WHEN n > 2 * t THEN 'split' WHEN 2 * n < t THEN 'merge' ELSE 'keep' END AS action FROM n, t", lambda s, d: index(s, d).plan())
define("ivf_rebuild", f"{_COSINE},\n{oracles.rebuilt('cosine', (0, 1), 2)} {_PLACED.format('na')}", lambda s, d: again(s, d).rows().select("vec_id", "cluster_id"))
define("ivf_reassign", f"{_COSINE},\n{oracles.rebuilt('cosine', (0, 1), 2)},\nnx AS (SELECT vec_id, v, c AS label FROM na),\n{oracles.assigned('nn', 'nx', 'nc', 'cosine')} SELECT vec_id, label::INT AS cluster_id, c::INT AS nearest FROM nn WHERE label <> c", lambda s, d: again(s, d).reassign())

# ---------------------------------------------------------------- mutations

_ATTRS = ["last_click", "last_view", "last_purchase"]


def event_log(s: SparkSession, d: str) -> DataFrame:
    """Events as operations on users: a sign-up resets, an error deletes, others patch what they name."""
    e = table(s, d, "events")
    op = F.when(F.col("event_type") == "signup", "upsert").when(F.col("event_type") == "error", "delete").otherwise("patch")
    kind = lambda t: F.col("event_type") == t
    cells = [F.when(kind(a[5:]), F.col("value")).alias(a) for a in _ATTRS]
    return e.select(F.col("event_id").alias("seq"), F.lit(0).alias("op_idx"), F.col("user_id").alias("id"), op.alias("op"), *cells, F.when(op == "upsert", F.array(*map(F.lit, _ATTRS))).otherwise(F.array(F.concat(F.lit("last_"), "event_type"))).alias("set"))


def fold_sql(where: str = "true") -> str:
    cells = ", ".join(f"arg_max(CASE WHEN event_type = '{a[5:]}' THEN [value] WHEN event_type = 'signup' THEN [NULL] END, CASE WHEN event_type IN ('{a[5:]}', 'signup') THEN event_id END)[1] AS {a}" for a in _ATTRS)
    return f"""WITH l AS (SELECT *, max(CASE WHEN event_type IN ('signup', 'error') THEN event_id END) OVER (PARTITION BY user_id) AS reset FROM events WHERE {where}),
f AS (SELECT user_id AS id, arg_max(event_type, event_id) AS last, {cells} FROM l WHERE reset IS NULL OR event_id >= reset GROUP BY user_id)
SELECT id, {', '.join(_ATTRS)} FROM f WHERE last <> 'error'"""


define("fold_patch", fold_sql(), lambda s, d: mutations.fold(event_log(s, d), _ATTRS))
define("fold_upsert", fold_sql("event_type <> 'error'"), lambda s, d: mutations.fold(event_log(s, d).where("op <> 'delete'"), _ATTRS))
define("fold_delete", "SELECT user_id AS id FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) = 'error'", lambda s, d: event_log(s, d).groupBy("id").agg(F.max_by("op", "seq").alias("op")).where("op = 'delete'").select("id"))


def split_fold(s: SparkSession, d: str) -> DataFrame:
    """The first half of the log folded to a base, the rest laid over it."""
    log = event_log(s, d)
    half = log.agg((F.max("seq") / 2).cast("long").alias("h"))
    cut = log.crossJoin(F.broadcast(half))  # one row
    base = mutations.fold(cut.where("seq <= h").drop("h"), _ATTRS)
    return mutations.overlay(base, cut.where("seq > h").drop("h"), _ATTRS)


define("overlay_scan", fold_sql(), split_fold)


def in_batches(s: SparkSession, d: str, n: int, flushed: bool = True) -> Collection:
    """The event log in ``n`` batches of a collection, each flushed to a run of its own."""
    log = event_log(s, d)
    most = log.agg(F.max("seq")).first()[0] or 0
    c = Collection.create(s, work_path(s), "users")
    for i in range(n):
        part = log.where((F.col("seq") > most * i // n) & (F.col("seq") <= most * (i + 1) // n) | (F.lit(i == 0) & (F.col("seq") <= 0)))
        c.append_frame(part.select(F.col("seq").cast("int").alias("op_idx"), "id", "op", *_ATTRS, "set"), bulk=True)
        if flushed:
            c.flush()
    return c


def _kept(c: Collection) -> DataFrame:
    return c.df().select("id", *_ATTRS)


def _compacted_log(s, d):
    c = in_batches(s, d, 2)
    c.compact()
    return _kept(c)


def _tiered_log(s, d):
    c = in_batches(s, d, 4)
    c.tier()
    return _kept(c)


define("flush_equiv", fold_sql(), lambda s, d: _kept(in_batches(s, d, 2)))
define("tier_equiv", fold_sql(), _tiered_log)
define("compact_equiv", fold_sql(), _compacted_log)
define("unflushed_equiv", fold_sql(), lambda s, d: _kept(in_batches(s, d, 2, False)))
_NEWEST = "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id"


def runs(s: SparkSession, d: str, n: int) -> list[DataFrame]:
    e = table(s, d, "events").select("user_id", "event_type", "event_id")
    return [mutations.newest(e.where(F.pmod("event_id", F.lit(n)) == i), "user_id", "event_id") for i in range(n)]


def merge(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return mutations.newest(whole, "user_id", "event_id")


define("lsm_merge", _NEWEST, lambda s, d: merge(runs(s, d, 3)))
_BIG = "o_totalprice >= 100000"


def order_ops(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice")
    ops = orders.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "patch").otherwise("delete").alias("op"))
    return orders, ops.union(s.range(3).select((-F.col("id") - 1).alias("id"), F.element_at(F.array(*map(F.lit, ("upsert", "patch", "delete"))), (F.col("id") + 1).cast("int")).alias("op")))


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'patch' ELSE 'delete' END AS op, {_BIG} AS applied FROM orders WHERE o_orderkey % 3 = 0 UNION ALL VALUES (-1, 'upsert', true), (-2, 'patch', false), (-3, 'delete', false)")
def cond_write(s, d):
    return mutations.conditional(*order_ops(s, d), gte("o_totalprice", 100000.0))


@query(f"SELECT 1 + count(*) FILTER ({_BIG}) AS affected, 1::BIGINT AS upserted, count(*) FILTER ({_BIG} AND o_orderkey % 2 = 0) AS patched, count(*) FILTER ({_BIG} AND o_orderkey % 2 <> 0) AS deleted, 2 + count(*) FILTER (NOT {_BIG}) AS skipped FROM orders WHERE o_orderkey % 3 = 0")
def write_outcome(s, d):
    return mutations.outcome(mutations.conditional(*order_ops(s, d), gte("o_totalprice", 100000.0)))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def patch_by_filter(s, d):
    orders, _ = order_ops(s, d)
    ids, _ = mutations.select_for_write(orders, eq("o_orderstatus", "O"), None, False)
    hit = ids.withColumnRenamed("id", "hit")
    return orders.join(hit, orders["id"] == hit["hit"], "left").select("id", F.when(F.col("hit").isNotNull(), "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100)")
def delete_by_filter(s, d):
    orders, _ = order_ops(s, d)
    ids, _ = mutations.select_for_write(orders, eq("o_orderstatus", "F"), 100, True)
    return orders.join(ids, "id", "left_anti").select("id")


# ---------------------------------------------------------------- encodings and collections

define("id_sort_key", "SELECT doc_id, '01' || lpad(printf('%X', doc_id), 16, '0') AS sort_key FROM documents", lambda s, d: table(s, d, "documents").select("doc_id", ids.sort_key(F.col("doc_id")).alias("sort_key")))
define("content_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents", lambda s, d: table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha")))
_U = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"
define("id_uuid", f"SELECT doc_id, {_U} AS uuid, h AS bytes FROM (SELECT doc_id, md5(doc_id::VARCHAR) AS h FROM documents)", lambda s, d: table(s, d, "documents").select("doc_id", F.upper(F.expr(_U.replace("h,", "md5(cast(doc_id AS string)),"))).alias("given")).where(F.col("given").rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")).select("doc_id", F.lower("given").alias("uuid"), F.lower(F.hex(F.unhex(F.replace("given", F.lit("-"), F.lit(""))))).alias("bytes")))


_HALF = "list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END)"
define("f16_roundtrip", f"SELECT vec_id, generate_subscripts(h, 1)::INT AS pos, unnest(h)::DOUBLE + 0.0 AS x FROM (SELECT vec_id, {_HALF} AS h FROM embeddings)", lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode(vectors.half(F.col("embedding"))).alias("pos", "x")).select("vec_id", (F.col("pos") + 1).alias("pos"), (F.col("x").cast("double") + 0.0).alias("x")))
define("ingest_json", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events", lambda s, d: json_documents(table(s, d, "events"), "props", "event_id").select("event_id", "k"))

_FILL = {
    "orders": lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"), F.col("o_custkey").cast("long").alias("region"), F.col("o_totalprice").alias("price")),
    "documents": lambda s, d: table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "text"),
    "events": lambda s, d: table(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("long").alias("user_id"), "event_type", "value"),
}


def collection(s: SparkSession, d: str, source: str = "orders", **options) -> tuple[Collection, str]:
    """A collection in the shared folder, filled from every row of a table in one batch."""
    root = work_path(s)
    c = Collection.create(s, root, "orders", **options)
    c.append_frame(_FILL[source](s, d).withColumn("op", F.lit("upsert")), bulk=True)
    return c, root


_ORDERS = "SELECT o_orderkey::BIGINT AS id, o_orderstatus AS name, o_custkey::BIGINT AS region, o_totalprice::DOUBLE AS price FROM orders"
_DOCUMENTS = "SELECT doc_id AS id, lang, source, text FROM documents"


def _with(f: Callable, source: str = "orders", **options):
    return lambda s, d: f(s, *collection(s, d, source, **options))


def _export(s, c, root):
    c.export_to(f"{root}/out")
    return s.read.parquet(f"{root}/out/data")


def _branch(s, c, root, changed="name"):
    c.flush()
    b = c.branch("child")
    b.append([{"id": 0, "op": "delete"}, {"id": 1, "op": "patch", "attributes": {changed: "changed"}}])
    return b.df().select(F.lit("child").alias("side"), "*").union(c.df().select(F.lit("parent"), "*"))


def _compacted(s, c, root):
    c.flush()
    c.append([{"id": 2, "op": "delete"}])
    c.compact()
    return c.df()


def _idempotent(s, c, root):
    one = [{"id": -100, "op": "upsert", "attributes": {"name": "new", "region": 9}}]
    a, b = c.append(one, key="k"), c.append(one, key="k")
    return c.df().where("id < 0").select("id", "name", "region", F.lit(a == b).alias("same"))


def _written_by_filter(s, c, root):
    """Patches and deletions by filter, before and after a flush, as batches that Spark writes."""
    c.patch_by_filter(eq("name", "O"), {"name": "open"}, max_rows=None)
    c.flush()
    c.delete_by_filter(gte("price", 200000.0), max_rows=None, key="d")
    c.delete_by_filter(gte("price", 200000.0), max_rows=None, key="d")
    return c.df()


def _searched(s, c, root):
    """Text and filters through a collection whose text index a flush has made."""
    c.flush()
    found = c.query({"text": {"column": "text", "query": "attion thing", "k": 20}, "filter": {"Eq": {"column": "lang", "value": "en"}}}).rows
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


_TURNED = "SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN vec_id % 4 = 1 THEN -x ELSE x END) AS v FROM embeddings WHERE vec_id % 9 <> 8"


@query(f"WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0), hits AS (SELECT id, list_cosine_similarity(v, qv) AS score FROM ({_TURNED}), q)" + top_sql(10, "id"))
def collection_ann(s, d):
    """A collection's own vector index after a flush, an appended flush and a tail that isn't flushed, all clusters probed."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    turned = e.where("id % 4 = 1").withColumn("embedding", F.transform("embedding", lambda x: -x))
    c = Collection.create(s, work_path(s), "vectors")
    c.append_frame(e.withColumn("op", F.lit("upsert")), bulk=True)
    c.flush()
    c.append_frame(turned.where("id % 8 = 1").withColumn("op", F.lit("upsert")))
    c.flush()
    c.append_frame(turned.where("id % 8 = 5").withColumn("op", F.lit("upsert")))
    c.append_frame(e.where("id % 9 = 8").select("id", F.lit("delete").alias("op")))
    found = c.query({"approx_vector": {"column": "embedding", "vector": query_vector(s, d), "k": 10, "probes": 16}}).rows
    return found.select("id", F.round("score", 6).alias("score"), "rank")


define("wal_append", _ORDERS, _with(lambda s, c, root: c.df()))
define("export_roundtrip", _ORDERS, _with(_export))
define("copy_equiv", _ORDERS, _with(lambda s, c, root: (c.flush(), c.copy_to(root, "copy").df())[1]))
define("collection_compact", f"SELECT * FROM ({_ORDERS}) WHERE id <> 2", _with(_compacted))
define("branch_diverge", f"SELECT 'parent' AS side, * FROM ({_ORDERS}) UNION ALL SELECT 'child', id, CASE WHEN id = 1 THEN 'changed' ELSE name END, region, price FROM ({_ORDERS}) WHERE id <> 0", _with(_branch))
define("idempotent_append", "SELECT -100::BIGINT AS id, 'new' AS name, 9::BIGINT AS region, true AS same", _with(_idempotent))
define("collection_by_filter", f"SELECT id, CASE WHEN name = 'O' THEN 'open' ELSE name END AS name, region, price FROM ({_ORDERS}) WHERE price < 200000", _with(_written_by_filter))
define("collection_text", bm25_sql({"attion": 1, "thing": 1}, where="lang = 'en'") + top_sql(20), _with(_searched, "documents", text=("text",)))
define("wal_append_events", "SELECT event_id AS id, user_id::BIGINT AS user_id, event_type, value FROM events", _with(lambda s, c, root: c.df(), "events"))
define("export_documents", _DOCUMENTS, _with(_export, "documents"))
define("copy_documents", _DOCUMENTS, _with(lambda s, c, root: (c.flush(), c.copy_to(root, "copy").df())[1], "documents"))
define("compact_documents", f"SELECT * FROM ({_DOCUMENTS}) WHERE id <> 2", _with(_compacted, "documents"))
define("branch_documents", f"SELECT 'parent' AS side, * FROM ({_DOCUMENTS}) UNION ALL SELECT 'child', id, CASE WHEN id = 1 THEN 'changed' ELSE lang END, source, text FROM ({_DOCUMENTS}) WHERE id <> 0", _with(lambda s, c, root: _branch(s, c, root, "lang"), "documents"))
_META = "SELECT 'orders' AS name, {0}::BIGINT AS generation, {0}::BIGINT AS indexed, 1::BIGINT AS committed, {1}::BIGINT AS lag, {0}::INT AS runs, count(*) AS approx_rows, 'bigint' AS ids, 1::BIGINT AS schema_version FROM documents"
_META_COLUMNS = ["name", "generation", "indexed", "committed", "lag", "runs", "approx_rows", "ids", "schema_version"]
define("metadata", _META.format(0, 1), _with(lambda s, c, root: c.metadata().select(*_META_COLUMNS), "documents"))
define("index_lag", _META.format(1, 0), _with(lambda s, c, root: (c.flush(), c.metadata().select(*_META_COLUMNS))[1], "documents"))


@query(fold_sql())
def streamed_fold(s, d):
    """The log read as a stream, in batches written to their own places, and folded."""
    from orrery.streaming.ingest import stream_log

    root = work_path(s, "stream-")
    log = event_log(s, d)
    log.repartition(3).write.parquet(f"{root}/log")
    done = stream_log(s, f"{root}/log", log.schema, lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/checkpoint", 1)
    done.awaitTermination()
    return mutations.fold(s.read.parquet(f"{root}/out").drop("batch"), _ATTRS)
