
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import matches_expectation, path_has_prefix, slice_lines

#: Upper bounds of latency buckets in seconds (fixed values; E10).
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]
PAGE = 50


def first_n_unique_docs(hits: DataFrame, n: int) -> DataFrame:
    """F8, H4: (query_id, rel_path, doc_rank): distinct documents of a query's ``hits`` (rank, rel_path) in the order in
    which they are first seen, the first ``n``."""
    first = hits.groupBy("query_id", "rel_path").agg(F.min("rank").alias("first"))
    return first.withColumn("doc_rank", F.row_number().over(W.partitionBy("query_id").orderBy("first", "rel_path"))).filter(F.col("doc_rank") <= n).drop("first")


def doc_rank(golden: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """(query_id, query, rank): place among the first ``n`` documents of the first one that is expected, 0 if none."""
    docs = first_n_unique_docs(hits, n).join(golden.select("query_id", "expect"), "query_id")
    found = docs.filter(matches_expectation(F.col("rel_path"), F.col("expect"))).groupBy("query_id").agg(F.min("doc_rank").alias("rank"))
    return golden.join(found, "query_id", "left").select("query_id", "query", F.coalesce("rank", F.lit(0)).cast("int").alias("rank"))


def recall_mrr(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """E5: ``queries``, ``recall_at_1``, ``recall_at_n`` and ``mrr`` of ranks (0: missed)."""
    hit = F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(0.0)
    return results.groupBy(*by).agg(F.count("*").alias("queries"), F.avg((F.col("rank") == 1).cast("double")).alias("recall_at_1"), F.avg((F.col("rank") >= 1).cast("double")).alias("recall_at_n"), F.avg(hit).alias("mrr"))


def percentile_nearest_rank(value: str, p: float) -> Column:
    """The smallest value with at least the share ``p`` at or below it; 0 without values."""
    return F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)"), F.lit(0))


def misses(results: DataFrame) -> DataFrame:
    """Queries without a hit."""
    return results.filter("rank = 0")


def eval_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Queries whose rank changed from run ``a`` to run ``b``."""
    return a.select("query_id", "query", F.col("rank").alias("rank_a")).join(b.select("query_id", F.col("rank").alias("rank_b")), "query_id").filter("rank_a <> rank_b")


def parity_compare(golden: DataFrame, new: DataFrame, legacy: DataFrame, n: int) -> DataFrame:
    """(query_id, new_hit, legacy_hit) from two systems' hits; a query without results, or that failed, is a miss."""
    hit = lambda hits, name: doc_rank(golden, hits, n).select("query_id", (F.col("rank") > 0).alias(name))
    both = hit(new, "new_hit").join(hit(legacy, "legacy_hit"), "query_id", "full_outer")
    return both.select("query_id", F.coalesce("new_hit", F.lit(False)).alias("new_hit"), F.coalesce("legacy_hit", F.lit(False)).alias("legacy_hit"))


def parity_gate(compared: DataFrame) -> DataFrame:
    """Hits of either side and whether the new one has at least as many."""
    out = compared.agg(F.count("*").alias("queries"), F.count_if("new_hit").alias("new_hits"), F.count_if("legacy_hit").alias("legacy_hits"))
    return out.withColumn("pass", F.col("new_hits") >= F.col("legacy_hits"))


def kb_stats(kbs: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents, chunks and the last time of indexing (0 if none) of every knowledge base."""
    d = docs.groupBy("kb").agg(F.count("*").alias("documents"), F.max("indexed_at").alias("last"))
    c = chunks.groupBy("kb").agg(F.count("*").alias("chunks"))
    zero = F.lit(0)
    return kbs.join(d, "kb", "left").join(c, "kb", "left").select("kb", F.coalesce("documents", zero).alias("documents"), F.coalesce("chunks", zero).alias("chunks"), F.coalesce("last", zero).alias("last_indexed_at"))


def reassemble_document(chunks: DataFrame) -> DataFrame:
    """(doc_id, text): chunks by ``seq``, an empty line between."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x.text), "\n\n").alias("text"))


def get_document(docs: DataFrame, chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents of ``keys`` (rel_path, source_name or null, start, end) with their lines; without a source the
    smallest source name counts."""
    asked = keys.withColumnRenamed("source_name", "wanted")
    found = docs.join(asked, "rel_path").filter("wanted is null or wanted = source_name")
    one = found.withColumn("n", F.row_number().over(W.partitionBy("rel_path", "wanted", "start", "end").orderBy("source_name"))).filter("n = 1").drop("n")
    texts = reassemble_document(chunks.join(one.select("doc_id").distinct(), "doc_id", "left_semi"))
    return one.join(texts, "doc_id").withColumn("text", slice_lines(F.col("text"), F.col("start"), F.col("end"))).drop("wanted")


def keyset_page(docs: DataFrame, prefix: str = "", cursor: tuple[str, str] | None = None, limit: int = PAGE) -> DataFrame:
    """Documents under a prefix after ``cursor`` (rel_path, source_name), in that order."""
    rows = docs.filter(path_has_prefix(F.col("rel_path"), prefix))
    if cursor:
        rows = rows.filter((F.col("rel_path") > cursor[0]) | ((F.col("rel_path") == cursor[0]) & (F.col("source_name") > cursor[1])))
    return rows.orderBy("rel_path", "source_name").limit(limit)


def latency_histogram(log: DataFrame, buckets: list[float] = BUCKETS) -> DataFrame:
    """Cumulative counts by ``kb`` and bucket (``le``, the last one infinite) of ``log`` (kb, seconds), with the number
    and sum of all.  One pass; nothing is exploded before it is counted."""
    bounds = [*buckets, float("inf")]
    counted = log.groupBy("kb").agg(F.count("seconds").alias("n"), F.sum("seconds").alias("total"), *(F.count_if(F.col("seconds") <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(bounds)))
    cells = F.array(*(F.struct(F.lit("+Inf" if b == float("inf") else f"{b:g}").alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)))
    return counted.select("kb", "n", "total", F.explode(cells).alias("c")).select("kb", "c.le", "c.count", "n", "total")


def operation_counts(log: DataFrame) -> DataFrame:
    """Number of operations by ``kb`` and ``op``."""
    return log.groupBy("kb", "op").agg(F.count("*").alias("n"))


def eval_json(results: DataFrame, run: str) -> DataFrame:
    """One JSON text for each result, keyed by run; to be written with ``df.write.text``."""
    return results.select(F.to_json(F.struct(F.lit(run).alias("run"), "query_id", "query", "rank")).alias("value"))
