
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import FORMATS, content_hash, is_indexable

BINARY = "path string, modificationTime timestamp, length long, content binary"


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").schema(BINARY).load(root)


def _rel_path(root: str) -> Column:
    """Path below ``root``; listings give full URIs, so the root is found inside them."""
    bare = root.split("://", 1)[-1].rstrip("/")
    bare = bare if bare.startswith("/") else "/" + bare.split("/", 1)[-1]
    return F.substring_index(F.col("path"), bare + "/", -1) if "/" in bare[1:] else F.regexp_replace("path", "^[a-z0-9]+:/*", "")


def listed(files: DataFrame, include: list[str] = (), exclude: list[str] = (), formats: dict[str, list[str]] = FORMATS, dot_folders: bool = False) -> DataFrame:
    """Those of ``files`` (rel_path, ...) that can be indexed.  Folders whose name begins with a dot are left out
    (``dot_folders``: kept, as in object stores)."""
    if not dot_folders:
        files = files.filter(~F.col("rel_path").rlike(r"(^|/)\.[^/]*/"))
    return files.filter(is_indexable(F.col("rel_path"), include, exclude, formats))


def list_files(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), formats: dict[str, list[str]] = FORMATS, dot_folders: bool = False) -> DataFrame:
    """A1, A2, A3: (rel_path, size_bytes, mtime) of files under ``root``, as ``listed``; contents aren't read.

    Spark's own listing drops names that begin with a dot or an underscore in any case, and files without a byte, which have
    nothing to index."""
    rows = _files(spark, root).select(_rel_path(root).alias("rel_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    return listed(rows, include, exclude, formats, dot_folders)


def safe_path(path: Column) -> Column:
    """A4: does a relative path stay below its root?"""
    return ~path.rlike(r"^/|(^|/)\.\.(/|$)")


def contents(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(rel_path, text, content_sha256, size_bytes) of those of ``files`` (rel_path, content, length) that ``paths`` (rel_path)
    names; paths that would leave the root are dropped."""
    wanted = paths.filter(safe_path(F.col("rel_path"))).select("rel_path").distinct()
    rows = files.join(wanted, "rel_path", "left_semi")
    return rows.select("rel_path", F.decode("content", "UTF-8").alias("text"), content_hash(F.col("content")).alias("content_sha256"), F.col("length").alias("size_bytes"))


def read_content(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """``contents`` of the files under ``root`` that ``paths`` names, and of no others; files are read where the join
    on paths leaves them."""
    return contents(_files(spark, root).withColumn("rel_path", _rel_path(root)), paths)


def golden_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, expect) from JSON lines ``{"query", "expect": []}``; an empty set is an error."""
    rows = spark.read.schema("query string, expect array<string>").json(path).filter("query is not null")
    if rows.isEmpty():
        raise ValueError("no golden queries")
    return rows.select(F.xxhash64("query").alias("query_id"), "query", F.coalesce("expect", F.array().cast("array<string>")).alias("expect"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.  Where that is unset, a session on one machine
    gets a temporary folder; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return the table read back, with ``df``'s schema: it cuts the
    lineage and survives lost executors.  Without ``compression`` it is the session's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Deletes a table that ``written`` made and nothing reads any more."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
