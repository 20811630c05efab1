"""A corpus pipeline in five stages, each one of the operators in ``lakesearch.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesearch.llm import decontaminate, mixing, near_copies, substring_dedup, toxicity
from lakesearch.llm.queries import held_out
from lakesearch.llm.store import fresh, written



def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; it learns from the labels outside the held-out fold.

    Null and empty texts are scored as texts without words; repeated rows have one fate; without labels of both classes all
    scores are the same.  Columns stay as they are, whatever their names; an empty table gives an empty one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    model = toxicity.train(docs, labels)
    scored = toxicity.with_toxicity(docs, model, name=(name := fresh(docs, "toxicity")))
    return scored.filter(F.col(name) < 0.5).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id stays.

    Texts without words, null ones too, are copies of each other.  Rows with a null id, and all rows that share the id that
    stays, stay.  Columns stay as they are, whatever their names; an empty table gives an empty one."""
    return near_copies.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that a document with a smaller id has too go; every document stays, with what is left of it and
    ``n_chars`` set right.

    Null texts stay null.  Rows with one id count as one document, null ids rank behind all others.  Other columns stay as
    they are, whatever their names; an empty table gives an empty one."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = substring_dedup.drop_repeats(docs.select("doc_id", "text", *([F.struct(*others).alias("others")] if others else [])))
    now = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(now[c].alias(c) if c in now else F.col("others")[c].alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts contain none; rows with a null id stay; rows with one id share their fate.  Columns stay as they are,
    whatever their names; an empty table gives an empty one."""
    return decontaminate.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``size``, ``source_size``, ``target``, ``taken`` and ``copies``, the number of times
    that each appears; columns of these names that ``docs`` has are replaced.

    Texts without words are never taken; null sources are one source.  An empty table gives an empty one."""
    kept = docs.drop(*[c for c in docs.columns if c.lower() == "copies"])
    return mixing.mix(kept).filter("taken > 0").withColumn("copies", (F.col("taken") / F.col("size")).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
]
#: Compression distances and fingerprints are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
