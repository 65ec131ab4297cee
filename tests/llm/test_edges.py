"""Nulls, empty tables, ties, repeated rows and clashing column names for every operator."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import bpe, caps, jaccard, lines, mixing, pii, secrets, tokens, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))


def odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\n ", "en", "a", 4), (None, "no id here", "en", None, 10),
            (4, LONG, "en", "b", len(LONG)), (5, "same text", "en", "b", 9), (5, "same text", "en", "b", 9), (6, "same text", None, "b", 9),
            (7, "x" * 50_000, "de", "a", 50_000), (8, "é€ \U0001f600 ß", "de", "c", 7)]
    return spark.createDataFrame(rows, DOCS)


def labels(spark, rows=((5, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# Each takes documents and labels and returns one row per document.
OPERATORS = {
    "bpe": lambda d, _: bpe.encode_documents(d),
    "secrets": lambda d, _: secrets.find_secrets(d),
    "pii": lambda d, _: pii.find_personal_data(d),
    "jaccard": lambda d, _: jaccard.similar(d),
    "toxicity": toxicity.score_documents,
    "lines": lambda d, _: lines.dedup_lines(d),
    "mixing": lambda d, _: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_documents(spark, name):
    docs = odd_documents(spark)
    ids = sorted(r["doc_id"] or 0 for r in docs.collect())
    clash = docs.withColumns({c: F.lit("clash") for c in (
        "score", "h", "id", "size", "key", "grp", "runs", "_h", "_d", "n_lines", "bpe_ids", "target", "predicted", "taken", "kept", "s", "base")})
    for d in (docs, clash):
        got = OPERATORS[name](d, labels(spark)).collect()
        assert sorted(r["doc_id"] or 0 for r in got) == ids


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS), labels(spark, ())).collect() == []


def test_odd_documents_in_the_pipeline(spark):
    docs = odd_documents(spark).withColumn("_h", F.lit(1)).withColumn("size", F.lit("x"))
    columns = docs.columns
    for stage in (lambda d: toxicity.without_toxic(d, labels(spark)), lines.without_repeats, jaccard.without_copies):
        docs = stage(docs)
        assert docs.columns == columns
    ids = [r["doc_id"] for r in docs.collect()]
    assert sorted(i or 0 for i in ids) == [0, 1, 2, 3, 4, 5, 7, 8]
    mix = mixing.mixed(docs)
    assert mix.columns == columns and {r["doc_id"] for r in mix.collect()} <= set(ids) - {1, 2, 3}


def test_empty_table_in_the_pipeline(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    labels(spark, ()).write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_all_tokens_of_odd_documents_are_attributed(spark):
    docs = odd_documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    total = {r["doc_id"]: r["n_tokens"] for r in bpe.encode_documents(docs).collect()}
    got = {r["doc_id"]: r["n"] for r in tokens.attribute(docs).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got == total
    assert tokens.attribute(spark.createDataFrame([], DOCS)).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int"


def test_odd_vectors_in_search(spark):
    rows = [(0, [1.0, 0.0], 0), (20, None, 1), (40, [float("nan"), 1.0], 1), (60, [None, 1.0], 1), (80, [float("inf"), 0.0], 1),
            (1, [1.0, 0.0], None), (2, [1.0, 0.0], 2), (3, [-1.0, 0.5], 2), (100, [], 2), (None, [1.0, 1.0], 2)]
    v = spark.createDataFrame(rows, VECTORS).select("vec_id", topk.quantised(F.col("embedding")).alias("q")).where("q is not null and vec_id is not null")
    got = topk.search(v, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 3).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 4096), (0, 2, 2, 4096), (0, 3, 100, 0), (100, 1, 0, 0), (100, 2, 1, 0), (100, 3, 2, 0)]
    empty = v.where("false")
    assert topk.search(empty, empty.withColumnRenamed("vec_id", "query_id")).collect() == []
    assert topk.search(v, empty.withColumnRenamed("vec_id", "query_id")).collect() == []


def test_repeated_ids_large_components_and_clashing_columns_in_search(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [0.5, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.quantised(F.col("embedding")).alias("q"))
    clash = v.withColumns({c: F.lit(1) for c in ("number", "block", "share", "rank", "score", "n")})
    for d in (v, clash):
        got = topk.search(d, d.where("vec_id = 0").withColumnRenamed("vec_id", "query_id"), 2).collect()
        assert sorted(tuple(r) for r in got) == [(0, 1, 1, 4096), (0, 1, 2, 4096), (0, 2, 1, 2048), (0, 2, 2, 2048)]
    large = spark.createDataFrame([(0, [3e17, 1.0]), (1, [3e17, 1.0])], "vec_id long, embedding array<double>") \
        .select("vec_id", topk.quantised(F.col("embedding")).alias("q"))
    with pytest.raises(ValueError, match="62 bits"):
        topk.search(large, large.withColumnRenamed("vec_id", "query_id"))


def test_links_beside_rows_without_ids(spark):
    big = 2 ** 60
    rows = [(big + 1, [1.0, 0.0]), (big + 3, [1.0, 0.01]), (None, [0.0, 1.0]), (None, [0.0, 2.0]), (5, [-1.0, -1.0]), (None, [-1.0, -1.001]), (5, [-1.0, -1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clash = v.withColumns({c: F.lit("x") for c in ("id", "v", "h", "times", "component", "least", "fs", "n_links", "kept")})
    want = {(big + 1, 1, big + 1, True), (big + 3, 1, big + 1, False), (None, 1, None, True), (5, 2, 5, True), (None, 2, 5, False)}
    for d in (v, clash):
        got = caps.near_vectors(d).collect()
        assert len(got) == len(rows) and {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got} == want


def test_odd_vectors_in_links(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.01], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [float("nan"), 1.0], 0), (6, [None, 1.0], 0),
            (7, [1.0, 0.0], 0), (8, [0.0, -3.0], 0), (9, [], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in caps.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 7: (2, 1, False), **{i: (0, i, True) for i in (3, 4, 5, 6, 8, 9)}}
    assert caps.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


def test_repeated_rows_are_one_group(spark):
    got = jaccard.similar(odd_documents(spark)).where("doc_id in (5, 6)").collect()
    assert {(r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in got} == {(5, 5, 2, True), (6, 5, 2, False)}
    left = jaccard.without_copies(odd_documents(spark)).where("doc_id in (5, 6)").collect()
    assert left == [Row(doc_id=5, text="same text", lang="en", source="b", n_chars=9)]
