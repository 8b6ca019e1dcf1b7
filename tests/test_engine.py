import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.errors import AlreadyExists, Backpressure, CasMismatch, IdempotencyConflict, InvalidQuery, InvalidSchema, InvalidWrite, NotFound
from orrery.functions import ids as id_kinds
from orrery.functions.text import tokenize_query, tokens
from orrery.operators import ivf, mutations, ranking
from orrery.operators.attributes import AttributeIndex
from orrery.operators.filters import And, Eq, Not, Or, Range, eq, gte
from orrery.operators.textindex import TextIndex
from orrery.plans.query import Indexes, Query, execute
from orrery.sources import collection as collections_
from orrery.sources.collection import Collection, parse_value
from orrery.sources.json_rows import documents as json_documents
from orrery.sources.storage import Storage

KIND = "id bigint, title string, score bigint, tags array<string>, embedding array<float>"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "alpha", 10, ["search", "rust"], [1.0, 0.0]), (2, "beta", 25, ["search"], [2.0, 0.0]), (3, "gamma", 5, ["cold"], [10.0, 0.0])], KIND).cache()


def ids(df):
    return [r.id for r in df.collect()]


def test_filter_order_and_aggregates(docs):
    q = Query(And((eq("tags", "search"), Range("score", (10, True), (30, False)))), ("score", True), None, ("Count", ("Sum", "score")))
    r = execute(docs, "id", q)
    assert ids(r.rows) == [2, 1]
    assert r.aggregates.first().asDict() == {"count": 2, "sum_score_values": 2, "sum_score": 35.0}


def test_count_is_before_the_limit(docs):
    r = execute(docs, "id", Query(Or((eq("title", "alpha"), Not(eq("tags", "search")))), (None, True), 1, ("Count",)))
    assert ids(r.rows) == [3] and r.aggregates.first()["count"] == 2


def test_two_valued_not(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id bigint, x bigint")
    assert ids(execute(df, "id", Query(~eq("x", 1))).rows) == [2, 3]
    assert ids(execute(df, "id", Query(~gte("nothing", 1))).rows) == [1, 2, 3]
    assert ids(execute(df, "id", Query(eq("x", 2.0))).rows) == [2]
    assert ids(execute(df, "id", Query(eq("x", "2"))).rows) == []
    assert ids(execute(df, "id", Query(Not(Eq("x", float("nan"))))).rows) == [1, 2, 3]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).withColumn("x", F.col("id")).write.parquet(str(tmp_path / "t"))
    plan = execute(spark.read.parquet(str(tmp_path / "t")), "id", Query(eq("x", 3.0))).rows._jdf.queryExecution().toString()
    assert "EqualTo(x,3)" in plan


def test_exact_vectors(docs):
    r = execute(docs, "id", Query(eq("tags", "search"), aggregates=("Count",), exact_vector={"column": "embedding", "vector": [0.0, 0.0], "k": 2, "metric": "l2"}))
    assert [(x.id, x.score) for x in r.rows.orderBy("rank").collect()] == [(1, -1.0), (2, -4.0)]
    for bad in ({"vector": [0.0, 0.0, 0.0]}, {"vector": [0.0, 0.0], "metric": "cosine"}, {"k": 10_001}):
        with pytest.raises(InvalidQuery):
            execute(docs, "id", Query(exact_vector={"column": "embedding", "vector": [1.0, 0.0], "k": 1, "metric": "l2"} | bad))


def test_text(spark):
    df = spark.createDataFrame([(1, "rust rust database"), (2, "rust database storage engine"), (3, "python database")], "id bigint, title string")
    r = execute(df, "id", Query(text={"column": "title", "query": "rust database", "k": 3}, aggregates=("Count",)))
    rows = r.rows.orderBy("rank").collect()
    assert [x.id for x in rows] == [1, 2, 3] and rows[0].score > rows[2].score and r.aggregates.first()["count"] == 3
    assert tokenize_query(spark, "Rust, BM25-search v2!") == ["rust", "bm25", "search", "v2"]
    assert spark.range(1).select(tokens(F.lit("Rust, BM25-search v2! " + "x" * 40)).alias("t")).first().t == ["rust", "bm25", "search", "v2"]
    with pytest.raises(InvalidQuery):
        ranking.Bm25(k1=0)


def test_query_and_document_tokens_agree(spark, tmp_path):
    """Marks that are letters but not alphanumeric in Python, a sigma at a word's end, letters that grow when lowered."""
    texts = ["हिन्दी भाषा", "ΟΔΟΣ και ΣΟΦΟΣ", "İstanbul STRASSE straße", "x" * 40 + " y"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    split = {r.id: r.t for r in df.select("id", tokens(F.col("t")).alias("t")).collect()}
    assert all(tokenize_query(spark, t) == split[i] for i, t in enumerate(texts))
    assert split[1] == ["οδοσ", "και", "σοφοσ"] and split[3] == ["y"]
    index = TextIndex.build(df, "id", "t", str(tmp_path / "i"))
    for i, t in enumerate(texts):
        for word in t.split()[:1] if i < 3 else ["y"]:
            for own in (None, index):
                assert ids(ranking.bm25(df, "id", "t", word, index=own)) == [i]


def bm25_by_hand(docs, query, k1=1.2, b=0.75, k3=8.0):
    split = {i: t.split() for i, t in docs if t and t.split()}
    average, out = sum(map(len, split.values())) / len(split), {}
    for term, q in Counter(query.split()).items():
        df = sum(term in t for t in split.values())
        for i, t in split.items():
            if f := t.count(term):
                out[i] = out.get(i, 0) + q * (k3 + 1) / (q + k3) * math.log(1 + (len(split) - df + 0.5) / (df + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(t) / average))
    return out


def test_text_index_by_brute_force(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([3, 30])]) for _ in range(rng.randint(0, 20)))) for i in range(900)] + [(1000, None)]
    df = spark.createDataFrame(docs, "id bigint, t string")
    index = TextIndex.build(df, "id", "t", str(tmp_path / "i"))
    assert (index.doc_count, index.total_len) == (sum(bool(t) for _, t in docs), sum(len((t or "").split()) for _, t in docs))
    blocks = index.blocks.collect()
    assert max(r.n for r in blocks) == 256 and all(len(r.ids) == r.n == len(r.tfs) and max(r.tfs) == r.max_tf and min(r.lens) == r.min_len for r in blocks)
    assert {(r.term, r.df) for r in index.term_stats().collect()} == {(w, sum(w in (t or "").split() for _, t in docs)) for w in words}
    for query, params in (("w1", {}), ("w0 w1 w29", {}), ("w2 w2 w7", {"k1": 2.0, "b": 0.3, "k3": 2.0}), ("none", {})):
        want = bm25_by_hand(docs, query, **params)
        for own in (None, index):
            got = {r.id: r.score for r in ranking.bm25(df, "id", "t", query, ranking.Bm25(**params), index=own).collect()}
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
        best = sorted(want.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]
        p = ranking.Bm25(**params)
        some = index.search(query, p.k1, p.b, p.k3, 5, least=0)
        assert [r.id for r in ranking.top(some.withColumn("score", F.round("score", 9)), "id", 5).orderBy("rank").collect()] == [i for i, _ in best]
    kept = ranking.bm25(df, "id", "t", "w1", keep=gte("id", 450), index=index)
    assert set(ids(kept)) == {i for i in bm25_by_hand(docs, "w1") if i >= 450}
    plan = index.search("w0 w1", 1.2, 0.75, 8.0)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_text_index_skips_blocks(spark, tmp_path):
    """Of 300 documents with one term the second block can't reach the best three."""
    df = spark.createDataFrame([(i, "rust " * (3 if i < 3 else 1) + "x " * (0 if i < 3 else 5)) for i in range(300)], "id bigint, t string")
    index = TextIndex.build(df, "id", "t", str(tmp_path / "i"))
    got = index.search("rust", 1.2, 0.75, 8.0, 3, least=1)
    assert ids(ranking.top(got, "id", 3)) == [0, 1, 2] and index.notes == {"read": 1, "skipped": 1, "scored": 256}


def test_one_tokenisation_without_an_index(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "id bigint, t string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = ranking.bm25(df, "id", "t", "a b c")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # once for the hits, once for the statistics


def vectors_of(n, dim, seed=1):
    return np.random.default_rng(seed).uniform(-1, 1, (n, dim)).astype(np.float32)


def test_index_finds_what_the_scan_does(spark, tmp_path):
    x = vectors_of(120, 16)
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id bigint, v array<float>, m int")
    index = ivf.Index.build(df, "id", "v", str(tmp_path / "i"), "l2", 1)
    q = [0.1] * 16
    exact = ids(ranking.top(ranking.knn(df, "id", "v", q, "l2"), "id", 10))
    assert ids(ranking.top(index.search(q, "l2", 16), "id", 10)) == exact
    assert len(set(exact) & set(ids(ranking.top(index.search_l2(q, 10, 16), "id", 10)))) >= 9
    few = index.search(q, "l2", 2)
    assert "PartitionFilters: [isnotnull(cluster_id" in (plan := few._jdf.queryExecution().toString()) or "PartitionFilters: [cluster_id" in plan
    assert set(ids(few)) == set(ids(index.rows().where(F.col("cluster_id").isin(index.probe(q, "l2", 2)))))
    only = index.search(q, "l2", 16, eq("m", 1))
    assert set(ids(only)) == {i for i in range(120) if i % 3 == 1}
    for bad in ([0.1] * 15, [float("nan")] * 16, []):
        with pytest.raises(InvalidQuery):
            index.search(bad, "l2")


def test_index_of_live_rows(spark, tmp_path):
    """What was deleted takes no place among the best, what moved or came later is scored as it is now."""
    row = lambda i, *v: (i, list(map(float, v)))
    kind = "id bigint, v array<float>"
    df = spark.createDataFrame([row(1, 1, 0), row(2, 2, 0), row(3, 3, 0)], kind)
    index = ivf.Index.build(df, "id", "v", str(tmp_path / "a"), "l2")
    fresh = spark.createDataFrame([row(2, 50, 0), row(4, 0, 1)], kind)
    gone = spark.createDataFrame([(1,), (2,), (4,)], "id bigint")
    assert ids(ranking.top(index.search([0.0, 0.0], "l2", 16, fresh=fresh, gone=gone), "id", 2)) == [4, 3]
    gone.write.parquet(str(tmp_path / "gone"))
    later = index.append(fresh, str(tmp_path / "b"), 1, str(tmp_path / "gone"))
    assert {r.id: (r.version, list(r.v)) for r in later.rows().collect()} == {2: (1, [50, 0]), 3: (0, [3, 0]), 4: (1, [0, 1])}
    assert ids(ranking.top(later.search([0.0, 0.0], "l2", 16), "id", 2)) == [4, 3]
    stats = later.versions().collect()
    assert sum(r.live for r in stats) == 3 and sum(r.stale for r in stats) == 2 and sum(r.appended for r in stats) == 2
    got = ivf.recall(later, 3, 2, 16).collect()
    assert [(r.n_exact, r.n_ann, r.recall) for r in got] == [(2, 2, 1.0)] * 3 and ivf.averages(ivf.recall(later, 3, 2, 16)).first().recall == 1
    assert ivf.recall_at([1, 2, 3], [3, 9, 1], 2) == 0.0 and ivf.recall_at([1, 2], [2, 1], 5) == 1.0


def test_one_bit_estimates():
    """Within their error bounds of the true distances; the query in four bits comes close to the one in full."""
    x, c = vectors_of(300, 64).astype(float), np.zeros(64)
    q = vectors_of(1, 64, 5)[0].astype(float)
    bits, norm, product = ivf.codes(x, c)
    estimate, error = ivf.estimates(bits, norm, product, q, c)
    true = ((x - q) ** 2).sum(1)
    assert (np.abs(estimate - true) <= error).mean() > 0.9
    short = ivf.packed_estimates(np.packbits(bits, axis=1), norm, product, q, c)
    assert np.abs(short - estimate).mean() < 0.03 * true.mean()


def test_index_of_nothing(spark, tmp_path):
    index = ivf.Index.build(spark.createDataFrame([(1, None)], "id bigint, v array<float>"), "id", "v", str(tmp_path / "i"))
    assert index.search([1.0, 0.0]).collect() == [] and index.rows().count() == 0


def test_kmeans_by_hand(spark):
    x = vectors_of(90, 5, 3).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors_of(90, 5, 3))], "id bigint, v array<float>")
    for metric in ("l2", "cosine"):
        c = x[[i * 90 // 10 for i in range(10)]]
        for _ in range(8):
            s = -((x[:, None] - c[None]) ** 2).sum(2) if metric == "l2" else (x @ c.T) / np.linalg.norm(c, axis=1)
            at = s.argmax(1)
            c = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(10)])
            c = c / np.linalg.norm(c, axis=1, keepdims=True) if metric == "cosine" else c
        assert np.allclose(ivf.kmeans(df, "id", "v", metric), c)


def test_fold_by_hand(spark):
    """Random histories: a reset, then what is mentioned, cleared or not, in order."""
    rng = random.Random(4)
    log, state = [], {}
    for seq in range(400):
        i, op = rng.randrange(12), rng.choice(["upsert", "patch", "patch", "patch", "delete"])
        named = ["a", "b"] if op == "upsert" else rng.sample(["a", "b"], rng.randint(0, 2)) if op == "patch" else []
        cells = {k: rng.choice([None, rng.randrange(9)]) for k in named}
        log.append((seq // 3, seq % 3, i, op, cells.get("a"), cells.get("b"), named))
        if op == "delete":
            state.pop(i, None)
        else:
            state[i] = ({"a": None, "b": None} if op == "upsert" else state.get(i, {"a": None, "b": None})) | cells
    df = spark.createDataFrame(log, "seq bigint, op_idx int, id bigint, op string, a int, b int, `set` array<string>")
    assert {r.id: {"a": r.a, "b": r.b} for r in mutations.fold(df, ["a", "b"]).collect()} == state
    half = df.where("seq < 70")
    assert {r.id: {"a": r.a, "b": r.b} for r in mutations.overlay(mutations.fold(half, ["a", "b"]), df.where("seq >= 70"), ["a", "b"]).collect()} == state


def test_attribute_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 5, ["a", "b", "a"], True), (2, "y", None, ["b"], False), (3, None, -7, [], None), (4, "x", 10, None, True)], "id bigint, s string, n bigint, tags array<string>, f boolean")
    index = AttributeIndex.build(df, "id", ["s", "n", "tags", "f"], str(tmp_path / "i"))
    get = lambda d: sorted(ids(d))
    assert get(index.ids_for_eq("s", "x")) == [1, 4] and get(index.ids_for_eq("tags", "b")) == [1, 2] and get(index.ids_for_eq("f", True)) == [1, 4] and get(index.ids_for_eq("n", 5.0)) == [1]
    assert get(index.ids_for_range("n", (-7, False), (10, True))) == [1, 4] and get(index.ids_for_range("n", None, (5, True))) == [1, 3] and get(index.ids_for_range("s", ("x", False))) == [2]
    assert get(index.all_ids("tags")) == [1, 2] and get(index.ids_for_range("n")) == [1, 3, 4] and get(index.ids_for_eq("s", 5)) == []
    assert "PartitionFilters: [isnotnull(column" in index.ids_for_eq("s", "x")._jdf.queryExecution().toString()


def test_json_documents(spark):
    rows = ['{"a": 1, "b": "x", "t": [1, 2]}', '{"a": 2, "c": 1.5, "f": true}', '{"c": 2, "b": null}', None]
    got = json_documents(spark.createDataFrame(list(enumerate(rows)), "id bigint, j string"), "j", "id")
    assert dict(got.dtypes) == {"id": "bigint", "a": "bigint", "b": "string", "c": "double", "f": "boolean", "t": "array<bigint>"}
    assert [tuple(r) for r in got.orderBy("id").select("a", "b", "c", "f", "t").collect()] == [(1, "x", None, None, [1, 2]), (2, None, 1.5, True, None), (None, None, 2.0, None, None), (None,) * 5]


def test_storage(spark, tmp_path):
    s = Storage(spark, str(tmp_path / "s"), 100)
    s.put("a/b.json", b"one")
    s.put("a/b.json", b"two")
    assert s.get("a/b.json", immutable=True) == b"two" and s.get("a/b.json") == b"two" and s.meter["hits"] == 1
    assert s.get_range("a/b.json", 1, 1) == b"w" and s.size("a/b.json") == 3 and s.list("a") == ["b.json"] and s.list("none") == []
    s.put_if_absent("a/c", b"x")
    with pytest.raises(AlreadyExists):
        s.put_if_absent("a/c", b"y")
    with pytest.raises(CasMismatch):
        s.compare_and_set("a/c", b"z", b"y")
    s.compare_and_set("a/c", b"x", b"y")
    assert s.get("a/c") == b"y" and s.list("a") == ["b.json", "c"]
    s.delete("a/c")
    for call in (lambda: s.get("a/c"), lambda: s.get_range("a/c", 0, 1)):
        with pytest.raises(NotFound):
            call()
    for bad in ("../x", "a/../../x", "/x", "a//b", "."):
        with pytest.raises(InvalidWrite):
            s.path(bad)
    assert {r.counter for r in s.metrics().collect()} >= {"gets", "puts", "bytes_read", "mismatches"}


def test_collection(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path), "docs")
    up = lambda i, **a: {"id": i, "op": "upsert", "attributes": a}
    c.append([up(1, state="active", n=1), up(2, state="idle", n=2), up(3, state="active", n=3)], key="a")
    assert c.append([up(1, state="active", n=1), up(2, state="idle", n=2), up(3, state="active", n=3)], key="a") == {"seq": 1, "affected": 3, "upserted": 3, "patched": 0, "deleted": 0}
    with pytest.raises(IdempotencyConflict):
        c.append([up(9)], key="a")
    with pytest.raises(InvalidSchema):
        c.append([up(1, n="text")])
    c.flush()
    assert c.append_if([{"id": 1, "op": "patch", "attributes": {"n": 7}}, {"id": 2, "op": "delete"}, {"id": 4, "op": "patch", "attributes": {"n": 1}}], eq("state", "active")) | {"seq": 0} == {"seq": 0, "affected": 1, "upserted": 0, "patched": 1, "deleted": 0, "applied_ids": [1], "skipped_ids": [2, 4]}
    assert c.delete_by_filter(eq("state", "active"), 1, True)["rows_remaining"]
    with pytest.raises(InvalidWrite):
        c.patch_by_filter(gte("n", 0), {"n": 0}, 1)
    c.append([{"id": 2, "op": "patch", "attributes": {"state": None}}])
    expected = [(2, None, 2), (3, "active", 3)]
    rows = lambda: sorted((r.id, r.state, r.n) for r in c.df().collect())
    assert rows() == expected
    c.flush()
    assert rows() == expected
    c.compact()
    assert rows() == expected and c.gc(apply=True) and rows() == expected
    assert parse_value("3") == 3 and parse_value("true") is True and parse_value("x") == "x"


def test_append_frame(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path), "docs")
    df = spark.range(500).select("id", F.lit("upsert").alias("op"), (F.col("id") % 7).alias("n"), F.when(F.col("id") > 3, "x").alias("s"), F.array(F.lit(1.0).cast("float")).alias("v")).repartition(5)
    assert c.append_frame(df, key="a") == c.append_frame(df.repartition(2), key="a") == {"seq": 1, "affected": 500, "upserted": 500, "patched": 0, "deleted": 0}
    with pytest.raises(IdempotencyConflict):
        c.append_frame(df.where("id > 0"), key="a")
    for bad in (df.union(df), df.withColumn("op", F.lit("other")), df.withColumn("n", F.lit("text")), df.withColumn("v", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")), df.withColumn("f", F.lit(float("nan")))):
        with pytest.raises((InvalidSchema, InvalidWrite)):
            c.append_frame(bad)
    c.flush()
    c.append_frame(spark.createDataFrame([(1, "patch", 0, 70), (1, "patch", 1, 71), (2, "delete", 0, None)], "id bigint, op string, op_idx int, n bigint"))
    got = {r.id: (r.n, r.s, list(r.v)) for r in c.df().collect()}
    assert got == {i: (71 if i == 1 else i % 7, "x" if i > 3 else None, [1.0]) for i in range(500) if i != 2}
    assert len(list((tmp_path / "docs" / "wal").glob("*.parquet"))) == 2


def test_collection_queries_read_whole_tables_from_the_shared_folder(spark, tmp_path):
    from orrery.plans import catalogue

    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None:
        spark.sparkContext.setCheckpointDir(given := str(tmp_path / "shared"))
    for name, source in (("wal_append_events", "events"), ("export_documents", "documents"), ("wal_append", "orders")):
        df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.inputFiles() and all(given.removeprefix("file://") in f for f in df.inputFiles())
        assert df.count() == spark.read.parquet(f"/root/testdata/sf0.001/{source}.parquet").count()


def test_registered_indexes_take_the_default_rounds(spark, monkeypatch):
    from orrery.plans import catalogue

    rounds = []
    monkeypatch.setattr(ivf, "kmeans", lambda *a, rounds_=rounds, **kw: (rounds_.append(kw.get("rounds", ivf.ROUNDS)), [[x] * 64 for x in (-1.0, 0.5, 1.0)])[1])
    monkeypatch.setattr(catalogue, "_built", {})
    for name in ("ivf_centroids", "ivf_append", "ivf_reassign", "rabitq_encode"):
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert rounds == [ivf.ROUNDS] * 4 == [8] * 4


def test_collection_indexes(spark, tmp_path):
    """A flush publishes text and vector indexes; a search by them is right before and after, and with what isn't flushed."""
    c = Collection.create(spark, str(tmp_path), "docs", vectors={"v": {"dim": 2, "metric": "l2", "encoding": "f16"}}, text=("body",))
    doc = lambda i, body, *v: {"id": i, "op": "upsert", "attributes": {"body": body}, "vectors": {"v": list(v)}}
    c.append([doc(i, f"word{i % 3} common", float(i), 0.1) for i in range(12)])
    near = lambda k=2, **more: [r.id for r in c.query({"approx_vector": {"column": "v", "vector": [0.0, 0.0], "k": k, "probes": 16} | more}).rows.orderBy("rank").collect()]
    text = lambda q: sorted(r.id for r in c.query({"text": {"column": "body", "query": q, "k": 20}}).rows.collect())
    assert near() == [0, 1] and text("word1") == [1, 4, 7, 10] and c.indexes().vector == {}
    with pytest.raises(InvalidQuery):
        c.recall("v")
    c.flush()
    assert c.indexes().vector["v"].metric == "l2" and c.indexes().text["body"].doc_count == 12
    assert near() == [0, 1] and text("word1") == [1, 4, 7, 10] and c.query({"text": {"column": "body", "query": "word1", "k": 20}}).notes["read"] == 1
    assert c.df().where("id = 3").first().v[1] == float(np.float16(0.1))
    c.append([{"id": 0, "op": "delete"}, doc(1, "moved", 90.0, 0.0), doc(20, "word1 new", 0.25, 0.0)])
    assert near(3) == [20, 2, 3] and text("word1") == [4, 7, 10, 20] and c.recall("v", 5, 3, 16).agg(F.min("recall")).first()[0] == 1
    c.flush()
    assert near(3) == [20, 2, 3] and text("word1") == [4, 7, 10, 20] and len(c.indexes().vector["v"].tables) == 2
    assert c.warm(1 << 30) == ["vector v", "text body", "docs 0", "docs 1"] and c.warm(10) == []
    c.compact()
    assert near(3) == [20, 2, 3] and text("word1") == [4, 7, 10, 20] and len(c.indexes().vector["v"].tables) == 1
    both = c.multi_query([{"approx_vector": {"column": "v", "vector": [0.0, 0.0], "k": 1}}, {"filter": {"Eq": {"column": "body", "value": "moved"}}}])
    assert [ids(r.rows) for r in both] == [[20], [1]]
    with pytest.raises(InvalidQuery):
        c.query({"approx_vector": {"column": "v", "vector": [0.0], "k": 1}})
    with pytest.raises(InvalidSchema):
        c.append([doc(5, "x", 1e9, 0.0)])
    row = c.metadata().first()
    assert (row.committed, row.lag, row.approx_rows, row.text_indexes, row.vector_indexes) == (2, 0, 12, ["body"], ["v"])
    assert c.maintain() in ("nothing", "reassign v", "merge v", "split v") and near(3) == [20, 2, 3]
    child = c.branch("child")
    child.append([{"id": 20, "op": "delete"}])
    assert [r.id for r in child.query({"approx_vector": {"column": "v", "vector": [0.0, 0.0], "k": 2, "probes": 16}}).rows.orderBy("rank").collect()] == [2, 3] and near(2) == [20, 2]
    with c.reading() as snap:
        c.append([{"id": 2, "op": "delete"}])
        c.compact()
        assert not [p for p in c.gc(apply=True) if p.startswith("docs") and any(r["path"].endswith(p) for r in snap.manifest["docs"])]
        assert c.df(snap).count() == 12
    assert c.df().count() == 11 and child.df().count() == 11


def test_maintenance(spark, tmp_path, monkeypatch):
    """A crowded cluster is split, small ones are merged, runs are tiered and compacted; nothing is lost."""
    c = Collection.create(spark, str(tmp_path), "docs", vectors={"v": {"metric": "l2"}})
    x = np.concatenate([np.random.default_rng(0).normal(0, 0.1, (40, 2)), [[9, 9], [9, 8], [-9, 9], [9, -9]]])
    rows = [(i, "upsert", v.tolist()) for i, v in enumerate(x)]
    kind = "id bigint, op string, v array<float>"
    c.append_frame(spark.createDataFrame(rows, kind))
    c.flush()
    done = [c.maintain() for _ in range(4)]
    assert all(d.split()[0] in ("nothing", "merge", "split", "reassign") for d in done) and c.indexes().vector["v"].rows().count() == 44
    for i in range(3):
        c.append_frame(spark.createDataFrame([(100 + i, "upsert", [1.0, 1.0]), (i, "delete", None)], kind))
        c.flush()
    assert len(c.manifest()["docs"]) == 4 and c.maintain() == "tier" and [r["level"] for r in c.manifest()["docs"]] == [1]
    assert c.df().count() == 44 == c.indexes().vector["v"].rows().count()
    monkeypatch.setattr(collections_, "COMPACT_APPENDS", 2)
    assert c.maintain() == "compact" and c.df().count() == 44 and len(c.indexes().vector["v"].tables) == 1


def test_ids(spark, tmp_path):
    """Whole numbers beyond 63 bits; UUIDs before other text, in small letters."""
    c = Collection.create(spark, str(tmp_path), "big", ids=id_kinds.U64)
    c.append([{"id": i, "op": "upsert", "attributes": {"n": k}} for k, i in enumerate([2**64 - 1, 5, 2**63])])
    assert [int(r.id) for r in c.query({}).rows.collect()] == [5, 2**63, 2**64 - 1] and c.get(2**63).first().n == 2
    t = Collection.create(spark, str(tmp_path), "text")
    uuid = "0188F9A0-0000-7000-8000-00000000000A"
    t.append([{"id": i, "op": "upsert", "attributes": {"n": k}} for k, i in enumerate(["b", uuid, "00"])])
    t.append([{"id": uuid.lower(), "op": "patch", "attributes": {"n": 9}}])
    t.flush()
    assert [(r.id, r.n) for r in t.query({}).rows.collect()] == [(uuid.lower(), 9), ("00", 2), ("b", 0)] and t.get(uuid).first().n == 9
    assert [r.id for r in t.query({"order_by": {"target": "Id", "direction": "Desc"}}).rows.collect()] == ["b", "00", uuid.lower()]
    for bad, where in ((7, t), ("x" * 65, t), ("a", c), (-1, c), (True, c)):
        with pytest.raises(InvalidWrite):
            where.append([{"id": bad, "op": "upsert"}])
    assert id_kinds.route("a") == 0xAF63DC4C8601EC8C


def test_writes(spark, tmp_path, monkeypatch):
    c = Collection.create(spark, str(tmp_path), "docs")
    up = lambda i, **a: {"id": i, "op": "upsert", "attributes": a}
    c.append([up(1, n=1), up(2, n=2), up(3, n=3)])
    # a condition of its own for each operation
    done = c.append_if([up(1, n=10) | {"condition": {"Eq": {"column": "n", "value": 1}}}, {"id": 2, "op": "delete", "condition": eq("n", 5)}, {"id": 3, "op": "patch", "attributes": {"n": 30}}, up(4, n=4) | {"condition": eq("n", 0)}], key="k")
    assert (done["applied_ids"], done["skipped_ids"], done["upserted"], done["patched"]) == ([1, 3, 4], [2], 2, 1)
    again = [up(1, n=10) | {"condition": {"Eq": {"column": "n", "value": 1}}}, {"id": 2, "op": "delete", "condition": eq("n", 5)}, {"id": 3, "op": "patch", "attributes": {"n": 30}}, up(4, n=4) | {"condition": eq("n", 0)}]
    assert c.append_if(again, key="k") == done and c.commit() == 2
    with pytest.raises(IdempotencyConflict):
        c.append_if(again[:1], key="k")
    with pytest.raises(IdempotencyConflict):
        c.append([up(9)], key="k")
    with pytest.raises(InvalidSchema):
        c.append_if([up(1, n="text") | {"condition": eq("n", 99)}])
    # writes by filter never pass the driver, and repeat their outcome
    first = c.patch_by_filter(gte("n", 10), {"n": None, "s": "big"}, key="f")
    assert first["patched"] == 2 and not first["rows_remaining"] and c.patch_by_filter(gte("n", 10), {"n": None, "s": "big"}, key="f") == first
    assert sorted(r.id for r in c.batch(first["seq"]).collect()) == [1, 3] and c.delete_by_filter(eq("n", 77))["affected"] == 0
    assert {r.id: (r.n, r.s) for r in c.df().collect()} == {1: (None, "big"), 2: (2, None), 3: (None, "big"), 4: (4, None)}
    # a crash after the batch became visible, and one before
    real, calls = Storage.put, []

    def crash(self, name, data):
        if name.startswith("idempotency/") and not calls:
            calls.append(name)
            raise OSError("crash")
        return real(self, name, data)

    monkeypatch.setattr(Storage, "put", crash)
    with pytest.raises(OSError):
        c.append([up(50, n=1)], key="c")
    seq = c.commit()
    assert c.append([up(50, n=1)], key="c")["seq"] == seq == c.commit()
    absent = Storage.put_if_absent

    def lost(self, name, data):
        if name.startswith("wal/") and len(calls) == 1:
            calls.append(name)
            raise OSError("crash")
        return absent(self, name, data)

    monkeypatch.setattr(Storage, "put_if_absent", lost)
    with pytest.raises(OSError):
        c.append([up(51, n=1)], key="d")
    assert c.commit() == seq and c.append([up(51, n=1)], key="d")["seq"] == seq + 1 and c.get(51).count() == 1
    # too much that isn't indexed stops writes and strong reads, but not batches that bring whole documents
    monkeypatch.setattr(collections_, "MAX_UNINDEXED", 10)
    with pytest.raises(Backpressure):
        c.append([up(60)])
    with pytest.raises(Backpressure):
        c.append([{"id": 60, "op": "patch", "attributes": {"n": 1}}], bulk=True)
    with pytest.raises(Backpressure):
        c.df()
    c.append([up(60)], bulk=True)
    c.flush()
    assert c.get(60).count() == 1
    for bad in (".", "..", "a/b", ""):
        with pytest.raises(InvalidWrite):
            Collection(spark, str(tmp_path), bad)
    with pytest.raises(AlreadyExists):
        Collection.create(spark, str(tmp_path), "docs")
    assert Collection.create_or_open(spark, str(tmp_path), "docs").commit() == c.commit()
    with pytest.raises(NotFound):
        Collection.open(spark, str(tmp_path), "other")


def test_filters_on_large_numbers(spark):
    df = spark.createDataFrame([(1, 5)], "id bigint, x bigint")
    assert ids(execute(df, "id", Query(eq("x", 2**70))).rows) == [] and ids(execute(df, "id", Query(~eq("x", 2**70))).rows) == [1]


def test_text_columns_only(spark):
    df = spark.createDataFrame([(1, 5)], "id bigint, x bigint")
    with pytest.raises(InvalidQuery):
        execute(df, "id", Query(text={"column": "x", "query": "a", "k": 1}))
    with pytest.raises(InvalidQuery):
        execute(df, "id", Query(approx_vector={"column": "x", "vector": [1.0], "k": 1}), Indexes())


def test_writes_of_every_row(spark, tmp_path, monkeypatch):
    """Without a limit a write by filter takes all that match, however many; a limit counts them without passing them through one task."""
    c = Collection.create(spark, str(tmp_path), "docs")
    c.append_frame(spark.range(40).select("id", F.lit("upsert").alias("op"), (F.col("id") % 4).alias("n")))
    monkeypatch.setattr(Collection.delete_by_filter, "__defaults__", (9, False, None))
    with pytest.raises(InvalidWrite):
        c.delete_by_filter(gte("n", 1))
    assert c.delete_by_filter(gte("n", 3), partial=True)["rows_remaining"] and c.df().count() == 31
    assert c.patch_by_filter(gte("n", 0), {"n": 5}, max_rows=None)["patched"] == 31
    done = c.delete_by_filter(gte("n", 1), max_rows=None, key="d")
    assert done["deleted"] == 31 and not done["rows_remaining"] and c.delete_by_filter(gte("n", 1), max_rows=None, key="d") == done and c.df().isEmpty()


def test_collection_by_filter_has_no_limit(spark, tmp_path, monkeypatch):
    """The registered query deletes all that its SQL does, though a call's default limit is less."""
    from orrery.plans import catalogue

    spark.createDataFrame([(i, "O" if i % 2 else "F", 1, 100000.0 * (1 + i % 3)) for i in range(30)], "o_orderkey bigint, o_orderstatus string, o_custkey int, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(Collection.delete_by_filter, "__defaults__", (9, False, None))
    rows = catalogue.QUERIES["collection_by_filter"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.name) for r in rows) == [(i, "open" if i % 2 else "F") for i in range(0, 30, 3)]


def test_tokenize_of_no_tokens(spark, tmp_path):
    """A text without a token has no digest, as in the SQL; nor has no text."""
    import duckdb

    from orrery.plans import catalogue

    texts = ["One two", "", "!! --", "x" * 40, None, "é" * 20 + " é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = sorted(map(tuple, catalogue.QUERIES["tokenize"](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert own == sorted(db.execute(catalogue.SQL["tokenize"]).fetchall()) and [d for _, n, d in own if not n] == [None] * 4


def test_scores_add_in_the_querys_order(spark, tmp_path):
    """To the last bit, with an index and without: copies of a document tie, and the lesser id comes first."""
    rng = random.Random(5)
    once = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(once * 3)), "id bigint, t string").repartition(7)
    index = TextIndex.build(df, "id", "t", str(tmp_path / "i"))
    for own in (None, index):
        score = lambda q: {r.id: r.score for r in ranking.bm25(df, "id", "t", q, index=own).collect()}  # noqa: E731, B023
        parts = [score(t) for t in "fbda"]
        found = score("f b d a")
        for i, x in found.items():
            total = 0.0
            for p in parts:
                total += p.get(i, 0.0)
            assert x == total == found[i % 60]


def test_counting_takes_few_tokens_at_once(monkeypatch):
    import pyarrow as pa

    from orrery.operators import textindex

    rng = random.Random(6)
    docs = [[rng.choice("abcd") for _ in range(rng.choice((0, 1, 30, 900)))] for _ in range(300)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(301)), pa.array(docs, pa.list_(pa.string()))], names=["id", "_t"])
    monkeypatch.setattr(textindex, "SLICE", 1000, raising=False)
    out = list(textindex._count(iter([batch])))
    rows = [(r["id"], r["term"], r["tf"], r["len"]) for b in out for r in b.to_pylist()]
    assert sorted(rows) == sorted((i, t, n, len(d)) for i, d in enumerate(docs) if d for t, n in Counter(d).items())
    assert max(sum(b.column("tf").to_pylist()) for b in out) < 1000 + 900 and sum(sum(b.column("first").to_pylist()) for b in out) == sum(map(bool, docs))


def test_folding_takes_as_many_tasks_as_rows_ask_for(spark, tmp_path, monkeypatch):
    """More tasks than the session's four, unflushed, in a flush, over several runs and in a compaction; and the same rows."""
    monkeypatch.setattr(collections_, "PART_ROWS", 50, raising=False)
    c = Collection.create(spark, str(tmp_path), "docs")
    files = lambda: len([n for n in c.store.list(c.manifest()["docs"][-1]["path"].removeprefix(c.store.path() + "/")) if n.startswith("part-")])
    c.append_frame(spark.range(1000).select("id", F.lit("upsert").alias("op"), (F.col("id") % 4).alias("n"), F.lit("x").alias("s")))
    assert c.df().rdd.getNumPartitions() == 21
    c.flush()
    assert files() == 21
    c.append([{"id": 3, "op": "delete"}, {"id": 4, "op": "patch", "attributes": {"n": 9}}, {"id": 5, "op": "delete"}, {"id": 5, "op": "patch", "attributes": {"n": 7}}, {"id": 2000, "op": "patch", "attributes": {"s": "y"}}, {"id": 3000, "op": "delete"}])
    want = {i: (i % 4, "x") for i in range(1000)} | {4: (9, "x"), 5: (7, None), 2000: (None, "y")}
    del want[3]
    now = lambda: {r.id: (r.n, r.s) for r in c.df().collect()}
    assert now() == want and c.df().rdd.getNumPartitions() == 21
    c.flush()
    assert now() == want and c.df().rdd.getNumPartitions() == 21 and c.manifest()["docs"][1]["rows"] == 5
    c.append_frame(spark.range(0, 400, 2).select("id", F.lit("patch").alias("op"), F.lit(1).cast("long").alias("n")))
    want |= {i: (1, "x") for i in range(0, 400, 2)}
    c.flush()
    assert now() == want and c.manifest()["docs"][2]["rows"] == 200
    c.compact()
    assert now() == want and files() == 25  # of 1,205 versions
