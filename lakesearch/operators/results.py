"""

Results are stored in a folder that all executors share, by a digest of the model's name and of all that it is given, in 256
folders by the digest's first two digits.  They are appended before they are used; an append that fails leaves nothing that
is read, and two that store the same result do no harm.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import written
from .chunking import contextualize_chunks, embed_texts


@dataclass(frozen=True)
class ModelResults:
    """The results (of the SQL type ``kind``) of the model that ``model`` names, with its version and settings, below ``path``."""

    path: str
    model: str
    kind: str

    def key(self, *given: Column) -> Column:
        """Nulls differ from empty strings, and no two lists of strings have one key."""
        return F.sha2(F.to_json(F.array(F.lit(self.model), *given), {"ignoreNullFields": "false"}), 256)

    def known(self, keys: DataFrame) -> DataFrame:
        """(key, result) of those of ``keys`` (key) that are stored, once each."""
        rows = self._stored(keys.sparkSession)
        wanted = keys.select("key", _part()).distinct()
        return rows.join(wanted, ["part", "key"], "left_semi").dropDuplicates(["key"]).select("key", "result")

    def add(self, rows: DataFrame) -> None:
        """Store ``rows`` (key, result)."""
        self._stored(rows.sparkSession)
        rows.select("key", F.col("result").cast(self.kind).alias("result"), _part()).write.mode("append").partitionBy("part").parquet(self.path)

    def _stored(self, spark: SparkSession) -> DataFrame:
        schema = f"key string, result {self.kind}, part string"
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("part").parquet(self.path)
        return spark.read.schema(schema).parquet(self.path)


def _part() -> Column:
    # a letter first, so that no folder's name reads as a number
    return F.concat(F.lit("p"), F.substring("key", 1, 2)).alias("part")


def embed_once(chunks: DataFrame, embed: Callable[[list[str]], np.ndarray], dim: int, results: ModelResults, column: str = "embedding_text", batch: int = 32) -> DataFrame:
    """``embed_texts`` that gives the model each distinct text once, and none that ``results`` has.  Null texts are texts of their
    own, given to the model as empty ones; an empty table asks nothing.  Nothing is stored if the model fails."""
    keyed = chunks.withColumn("key", results.key(F.col(column)))
    texts = keyed.select("key", F.coalesce(column, F.lit("")).alias("given")).dropDuplicates(["key"])
    new = texts.join(results.known(texts), "key", "left_anti")
    results.add(embed_texts(new, embed, dim, "given", batch).select("key", F.col("embedding").alias("result")))
    return keyed.join(results.known(keyed), "key").drop("key").withColumnRenamed("result", "embedding")


def contextualize_once(chunks: DataFrame, docs: DataFrame, contextualizer: Callable[[str, str, str], str], results: ModelResults) -> DataFrame:
    """``contextualize_chunks`` that asks for no context that ``results`` has: a chunk's context depends on its title, document and
    text, so a changed document is asked for anew, an unchanged one that comes again (moved, copied, rebuilt) is not.

    ``chunks`` is read several times; it should be a stored table."""
    of_doc = docs.select("doc_id", results.key(F.col("title"), F.col("text")).alias("of_doc"))
    keyed = chunks.join(of_doc, "doc_id", "left").withColumn("key", results.key(F.col("of_doc"), F.col("text"))).drop("of_doc")
    before = keyed.join(results.known(keyed).withColumnRenamed("result", "known"), "key", "left")
    # a filter on what a model says would make Spark ask it twice, so its answers are written first
    made = written(contextualize_chunks(before, docs, contextualizer).select("key", "known", "context"), "contexts")
    # chunks that stand alone have no context and asked nothing
    results.add(made.filter("known is null and context <> ''").select("key", F.col("context").alias("result")).dropDuplicates(["key"]))
    after = results.known(keyed).withColumnRenamed("result", "context")
    return keyed.join(after, "key", "left").drop("key").withColumn("context", F.coalesce("context", F.lit("")))
