"""Operators and the pipeline on NULLs, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidepanel.llm import html_wrappers, quality, shingle_join, toxicity, vector_search

def clashing():
    return {"node": F.lit("n"), "doc": F.lit(1), "grade": F.lit("g"), "tails": F.lit(2.5), "host": F.lit("h"), "vector": F.lit("v"), "score": F.lit(True), "component": F.lit(0)}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeioulnrst"), rng.integers(3, 9))) for _ in range(300)]
    made = [(i, " ".join(rng.choice(words, 60)) + (" grumblefop" if i % 4 == 0 else "")) for i in range(160)]
    made += [(None, None), (None, made[1][1]), (None, "no id"), (500, None), (501, ""), (502, " \t\n"), (503, "lead " * 60_000), (504, made[5][1]), (504, made[5][1]), (7, "another text of seven")]
    docs = spark.createDataFrame([(i, t, "en", "s" if (i or 0) % 3 else None, len(t or "")) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns(clashing())


@pytest.fixture(scope="module")
def labels(spark):
    made = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(160)] + [(None, 1, 1), (3, None, None), (5, 1, 0), (5, 0, 0)]
    return spark.createDataFrame(made, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def counted(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_quality(spark, rows, labels):
    model = quality.train(rows, labels.select("doc_id", F.col("quality").alias("grade")), 2)
    got = quality.selected(rows, model, 2)
    assert counted(got, "doc_id") == counted(rows, "doc_id")
    assert all(0 <= r.tail_prob <= 1 and r.kept == (r.tail_prob >= 0.5) for r in got.collect())
    assert len(counted(got.where("doc_id = 504"), "tail_prob")) == 1
    assert quality.selected(rows.limit(0), model, 2).count() == 0
    none = quality.train(rows, labels.select("doc_id", F.lit(1).alias("grade")), 2)
    assert none is None and counted(quality.selected(rows, none, 2), "tail_prob") == {(0.5,): rows.count()}


def test_toxicity_with_a_model(spark, rows, labels):
    model = toxicity.train(rows, labels)
    assert model is not None
    got = toxicity.scored(rows.withColumn("toxic_score", F.lit("old")), model)
    assert counted(got, "doc_id") == counted(rows, "doc_id") and set(got.columns) == {*rows.columns, "toxic_score"}
    found = {r.doc_id: r.toxic_score for r in got.collect() if r.doc_id is not None}
    assert found[500] == found[501] == found[502] < 0.5 and found[503] < 0.5
    left = toxicity.without_toxic(rows, labels)
    assert left.columns == rows.columns and not left.where("text like '%grumblefop%'").count() and left.where("doc_id is null").count() == 3


def test_nearest_with_clashing_names_and_two_vectors_of_one_id(spark):
    made = [(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(45)] + [(20, [5.0, 5.0])]
    frame = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in made], "vec_id long, embedding array<double>, leaf int, rank int, query_id string, blocks int")
    asked = frame.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "leaf")
    got = vector_search.nearest(frame, asked, 5, recall=1.0).collect()
    assert counted(spark.createDataFrame(got), "query_id") == {(0,): 5, (20,): 5, (40,): 5}
    best = [r.vec_id for r in got if r.query_id == 0 and r.rank == 1]
    assert best == [20]


def test_html_of_nothing_and_of_clashing_names(spark):
    shape = "page_id long, url string, html string, host string, template int, found string, text int"
    page = "<body><nav>Menu</nav><article><p>Some words here</p></article></body>"
    frame = spark.createDataFrame([(1, "http://a.b/1", page, "h", 1, "f", 2), (None, "http://a.b/1", page, "h", 1, "f", 2), (3, None, "  ", None, None, None, None)], shape)
    got = counted(html_wrappers.extracted(frame), "page_id", "text")
    assert got == {(1, "Some words here"): 1, (None, "Some words here"): 1, (3, ""): 1}
    assert html_wrappers.extracted(frame.limit(0)).count() == 0


def test_linked_rows_without_ids(spark, rows):
    got = {}
    for r in shingle_join.linked(rows).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert got[504] == [got[504][0]] * 2 and got[504][0][1] == 5 and got[500] == [(0, 500)] and got[503] == [(1, 503)]
    # A row without an id joins the component of its text; alone it has no name.
    assert sorted(got[None], key=repr) == sorted([(0, None), (got[1][0][0], 1), (1, None)], key=repr)
    assert shingle_join.linked(rows.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tables(spark, rows, labels, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    labels.drop("text").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, rows.where("doc_id = 9").first().text), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_the_whole_pipeline(spark, rows, tables):
    """Every stage's decision, row by row, on rows that are odd in every way."""
    docs, kept_ids = rows, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.kept(stage(spark, docs, tables), name)
        assert docs.columns == rows.columns
        kept_ids[name] = counted(docs, "doc_id")
    toxic = {i for i in range(160) if i % 4 == 0}
    assert {i for (i,) in counted(rows, "doc_id") - kept_ids["toxicity"]} == toxic
    # Exact copies go (504 twice), rows without an id stay.
    assert counted(spark.createDataFrame([(i,) for (i,), n in (kept_ids["toxicity"] - kept_ids["ngram_jaccard"]).items() for _ in range(n)], "i long"), "i") == {(504,): 2, (7,): 1}
    assert {i for (i,) in kept_ids["ngram_jaccard"] - kept_ids["decontamination"]} == {9}
    assert kept_ids["secrets"] == kept_ids["decontamination"]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert {*rows.columns, "copies", "block", "place", "weight", "n_tokens"} <= set(last.columns)
    assert {i for (i,) in counted(last, "doc_id")} <= {i for (i,) in kept_ids["secrets"]}
    whole = corpus_pipeline.run(spark, tables)
    assert counted(whole, "doc_id", "copies", "block", "place") == counted(last, "doc_id", "copies", "block", "place")


def test_the_pipeline_of_nothing(spark, rows, labels, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.drop("text").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    rows.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
