"""Hits and queries are sent to the texts; the texts aren't shuffled for them."""

import re

from pyspark.sql import functions as F

from lakesearch import bindings
from lakesearch.operators import keyword, ranking


def shuffled(df):
    """Columns of each exchange of the executed plan that isn't a broadcast."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(?<!Broadcast)Exchange [a-z]+partitioning\(([^)]*)\)", plan.split("== Initial Plan ==")[0])


def test_texts_are_not_shuffled_for_hits(spark, tmp_path):
    n = 4000
    spark.range(n).select(F.col("id").alias("chunk_id"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).write.parquet(str(tmp_path / "c"))
    chunks, docs = spark.read.parquet(str(tmp_path / "c")), spark.range(n).select(F.col("id").alias("doc_id"), F.lit("p").alias("rel_path"))
    scores = spark.range(n).select(F.col("id").alias("chunk_id"), (F.col("id") % 5).alias("query_id"), F.rand(1).alias("rrf"))
    hits = ranking.fused_rank(scores).filter("rank <= 3")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        found = ranking.hydrate_hits(hits, chunks, docs)
        rows = found.select("query_id", "rank", "chunk_id", "text").collect()
        assert not [x for x in shuffled(found.select("query_id", "rank", "text")) if "chunk_id" in x]
        want = hits.join(chunks, "chunk_id").select("query_id", "rank", "chunk_id", "text").collect()
        assert sorted(rows) == sorted(want) and len(rows) == 15
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_texts_are_not_shuffled_for_golden_queries(spark, tmp_path, monkeypatch):
    texts = [(i, f"start word{i} alpha beta gamma end{i} and rest") for i in range(50)] + [(99, "alpha")]
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "word7 alpha beta gamma end7"), (2, "word7 alpha beta gamma end8"), (3, "alpha beta gamma"), (4, "alpha")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    path = lambda i: f"en/{i:08d}.txt"
    want = {1: [path(7)], 2: [], 3: [path(i) for i in range(50)], 4: [path(i) for i in [*range(50), 99]]}
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = bindings.golden(spark, str(tmp_path))
        assert {r.query_id: r.expect for r in got.collect()} == want
        assert not [x for x in shuffled(got) if "doc_id" in x or "run" in x]
        monkeypatch.setattr(keyword, "LISTED", 1)  # too many queries to be sent
        assert {r.query_id: r.expect for r in bindings.golden(spark, str(tmp_path)).collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
