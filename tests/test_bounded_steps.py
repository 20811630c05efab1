"""What a step takes doesn't depend on the session's partitions, and little is put together, fitted or asked for twice."""

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from lakesearch import bindings
from lakesearch.llm import near_copies, simhash, toxicity, training
from lakesearch.operators import keyword
from tests.test_keyword_blocks import corpus


def test_each_meeting_of_keyword_scores_is_a_task(spark):
    chunks = corpus(spark, 1000)
    queries = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(20)], "query_id long, query string")
    found = keyword.best(queries, keyword.postings(chunks).cache(), keyword.chunk_lengths(chunks).cache(), k=3, block=5, part=50)
    assert found.rdd.getNumPartitions() == 4 * 20  # four partitions in this session
    assert found.select("query_id").distinct().count() == 20


def test_runs_are_put_together_only_where_one_begins(spark, tmp_path):
    texts = [(1, "in  the beginning was the word and more"), (2, "nothing of it"), (3, "x the beginning was the y"), (4, "")]
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "the beginning was the word"), (2, "of it"), (3, "nothing"), (4, "absent words are not found here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = bindings.golden(spark, str(tmp_path))
    path = lambda i: f"en/{i:08d}.txt"
    assert {r.query_id: r.expect for r in got.collect()} == {1: [path(1)], 2: [path(2)], 3: [path(2)], 4: []}
    assert "filter(sequence" in got._jdf.queryExecution().optimizedPlan().toString()


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("qwyx zjqq vile")).otherwise(F.lit("plain fair words")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("long").alias("toxic"))
    rows, inner = training.sample(docs, labels, "toxic", 20, 100), toxicity.fit

    def fit(texts, toxic, odds):
        assert TaskContext.get() is not None or not texts, "the driver fits the model"
        return inner(texts, toxic, odds)

    monkeypatch.setattr(toxicity, "fit", fit)
    assert toxicity.train(docs, labels, per_class=20) == inner(rows["text"].tolist(), rows["y"].to_numpy(), rows.attrs["odds"])
    assert toxicity.train(docs.limit(0), labels).pairs == ()


@pytest.mark.parametrize(("edges", "tables"), [([(1, 2), (1, 3), (7, 9)], 2), ([], 2)])
def test_stars_are_settled_after_one_round(spark, monkeypatch, edges, tables):
    made, inner = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: (made.append(name), inner(df, name))[1])
    got = simhash.components(spark.createDataFrame(edges, "u long, v long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((b, a) for a, b in edges)
    assert len(made) == tables  # the edges, and those after one round


def test_later_rounds_link_groups_alone(spark, monkeypatch):
    """A group that fingerprints found is one node for the rounds that follow."""
    base = [f"w{i}" for i in range(60)]
    copies = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(0, 3)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([" ".join(base), *copies, "a b c d e f g"])], "doc_id long, text string")
    asked, inner = [], near_copies.components
    monkeypatch.setattr(near_copies, "components", lambda e: (asked.append(e.distinct().count()), inner(e))[1])
    got = {r.doc_id: r.component_id for r in near_copies.near_groups(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    assert asked[0] >= 3 and asked[1:] == [0, 0]  # not the links of earlier rounds again
