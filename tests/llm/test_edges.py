"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables, and extra columns whose names clash with inner ones."""

import pytest
from pyspark.sql import functions as F

from orrery.llm import bpe, licenses, mixing, quality, repeats, simhash, tiff, topk, toxicity

CLASH = ["toxic", "p_toxic", "_p", "gone_id", "gone", "rep", "anchor", "key", "own", "_part", "_source", "_at", "_n", "_tie", "copy_no", "_rep", "_key", "_spans", "_dg", "_copy", "_most", "_nulls", "dg", "h", "spans", "words", "odd", "size", "k0", "slot", "block", "n_tokens", "fold", "a.b"]
LONG = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "one two three", "en", "a", 13), (2, LONG, "en", None, len(LONG)), (3, LONG + " x", None, "a", None), (4, None, "en", "b", None), (None, "no id here", "en", "b", 10), (5, "", "de", "b", 0), (5, "", "de", "b", 0), (6, "z" * 300_000, "de", "a", 300_000), (7, "\n\t ", "de", "a", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH)).cache()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with labels as the stages expect them."""
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, 1, 0), (2, None, None), (3, 0, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


STAGES = [toxicity.reject_stage, simhash.dedup_stage, repeats.remove_stage, mixing.mix_stage]


@pytest.mark.parametrize("stage", STAGES, ids=lambda f: f.__name__)
def test_stages_keep_every_column(spark, clashing, sf, stage):
    out = stage(spark, clashing, sf)
    assert out.columns == clashing.columns and [f.dataType for f in out.schema] == [f.dataType for f in clashing.schema]
    rows = out.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASH)
    assert stage(spark, clashing.where("false"), sf).collect() == []


def test_stage_results(spark, clashing, sf):
    assert sorted(r.doc_id or -1 for r in simhash.dedup_stage(spark, clashing, sf).collect()) == [-1, 1, 2, 4, 5, 6, 7]
    left = {r.doc_id: (r.text, r.n_chars) for r in repeats.remove_stage(spark, clashing, sf).collect()}
    assert left[3] == ("x", 1) and left[5] == ("", 0) and left[7] == ("\n\t ", 3) and left[4] == (None, None) and left[2] == (LONG, len(LONG))
    assert toxicity.reject_stage(spark, clashing, sf).count() == 9


def test_operators_read_their_columns_only(spark, clashing, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    n = clashing.count()
    assert bpe.encode(clashing).count() == n and {r.doc_id: r.n_tokens for r in bpe.encode(clashing).collect()}[4] is None
    assert bpe.decode(bpe.encode(clashing)).count() == n
    counts = bpe.token_counts(clashing).collect()
    assert len(counts) == n and sorted(str((r.doc_id, r.n_tokens)) for r in counts) == sorted(str((r.doc_id, r.n_tokens)) for r in bpe.encode(clashing).collect())
    assert toxicity.score(clashing, toxicity.train(clashing, labels)).count() == n
    assert licenses.scan(clashing).count() == 0
    scored = quality.score(clashing, quality.train(clashing, labels)).collect()
    assert len(scored) == n and [r.p_quality for r in scored if r.doc_id == 4] == [None] and not any(r.keep for r in scored if r.doc_id == 4)
    assert {r.doc_id for r in simhash.near_duplicates(clashing).collect()} == {3}
    assert {(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in repeats.repeats(clashing).collect()} == {(3, 0, 60, 2)}


def test_operators_on_empty_tables(spark, clashing, sf):
    none, labels = clashing.where("false"), spark.read.parquet(f"{sf}/labels.parquet")
    for out in (bpe.encode(none), bpe.token_counts(none), bpe.decode(bpe.encode(none)), toxicity.score(none, toxicity.train(none, labels)), licenses.scan(none), quality.score(none, quality.train(none, labels)), simhash.near_duplicates(none), repeats.repeats(none), mixing.mix(none)):
        assert out.collect() == []
    assert toxicity.score(clashing, toxicity.train(clashing, labels.where("false"))).where("toxic").count() == 0
    assert tiff.pages(spark.createDataFrame([], "page_id bigint, media binary"), "page_id", "media").collect() == []
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []


def test_ids_are_whole_numbers(spark):
    docs = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    for op in (simhash.near_duplicates, repeats.repeats):
        with pytest.raises(TypeError, match="doc_id"):
            op(docs)


def test_mixing_weights(spark, clashing):
    assert mixing.mix(clashing, {"a": 0.0, "b": 0.0}).count() == 0
    assert {r.source for r in mixing.mix(clashing, {"a": 1.0, "b": 0.0}, 50).collect()} == {"a"}
    assert {r.source for r in mixing.mix(clashing, {None: 2.0}, 10).collect()} == {None} and mixing.mix(clashing, {None: 2.0}, 10).count() in (10, 11)
    assert mixing.mix(clashing, {}).count() == 0
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.mix(clashing, {"a": bad})
    with pytest.raises(ValueError):
        mixing.mix(clashing, columns=("doc_id", "copy_no"))


def test_queries_on_edge_tables(spark, clashing, tmp_path):
    """Every registered query and the last stage over tables of such rows, and over the same tables without a row."""
    from orrery.llm.queries import QUERIES

    extra = [F.lit("own").alias(c) for c in ("id", "q", "rank", "distance", "vec", "key", "error", "page_no", "license", "p_quality")]
    tables = {
        "documents": clashing,
        "labels": spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, None, None)], "doc_id bigint, quality int, toxic int").select("*", F.lit(1).alias("text")),
        "embeddings": spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, None), (None, [1.0, 1.0]), (100, []), (200, [1.0, float("nan")])], "vec_id bigint, embedding array<float>").select("*", *extra),
        "pages": spark.createDataFrame([(1, "<p>one</p>"), (1, "<p>one</p>"), (2, None), (None, ""), (3, "é" * 70_000)], "page_id bigint, html string").select("*", *extra),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / "full" / f"{name}.parquet"))
        df.where("false").write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    got = {name: f(spark, str(tmp_path / "full")).collect() for name, f in QUERIES.items()}
    assert {n: len(r) for n, r in got.items()} == {"op1_simhash": 1, "op2_bpe": 9, "op2_bpe_decoded": 9, "op3_licenses": 0, "op4_tiff": 6, "op5_topk": 1, "op6_token_counts": 9, "op7_mixing": len(got["op7_mixing"]), "op8_quality": 9, "op9_toxicity": 9, "op10_repeats": 1}
    assert 7 <= len(got["op7_mixing"]) <= 11 and tuple(got["op5_topk"][0]) == (0, 1, 1, 1.414214)
    assert {name: f(spark, str(tmp_path / "none")).collect() for name, f in QUERIES.items()} == {name: [] for name in QUERIES}
    staged = bpe.encode_stage(spark, clashing, "")
    assert staged.columns == ["doc_id", "lang", "source", "token_ids", "n_tokens", "round_trip"] and staged.count() == 9
    assert bpe.encode_stage(spark, clashing.where("false"), "").collect() == []
