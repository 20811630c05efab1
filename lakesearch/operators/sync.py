"""

Keys are (source_name, rel_path), with ``kb`` before them where the tables have it: equal paths in two knowledge bases are
two documents.  A document's rows in other tables hang on ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import content_hash, memory_id, render_uri

KEY = ["source_name", "rel_path"]
MANAGED = "managed"


def key_of(*tables: DataFrame) -> list[str]:
    """The key columns of tables that are compared: with ``kb`` if all have it, an error if only some do."""
    have = {"kb" in t.columns for t in tables}
    if len(have) > 1:
        raise ValueError("some tables have a column kb, others don't")
    return ["kb", *KEY] if have == {True} else list(KEY)


def _sides(now: DataFrame, was: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with a flag that is null where a join doesn't find them; their other columns may be null."""
    return now.withColumn("here", F.lit(True)).alias("now"), was.withColumn("known", F.lit(True)).alias("was")


_STATE = ("size_bytes", "mtime", "content_sha256")


def read_manifest(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """The manifest, or nothing if the knowledge base has no chunk at all, which forces a full sync."""
    return manifest.join(F.broadcast(chunks.limit(1).select(F.lit(1).alias("one")).agg(F.count("*").alias("n_chunks")))).filter("n_chunks > 0").drop("n_chunks")


def manifest_diff(listing: DataFrame, manifest: DataFrame, verify: bool = False) -> DataFrame:
    """One row for each key of ``listing`` (keys, size_bytes, mtime, content_sha256) or ``manifest``, with ``action``:
    ``skip`` (same size and time), ``touch`` (same hash), ``index`` or ``delete``.

    ``verify`` compares hashes even if size and time are the same.  Hashes of a lazy listing are only worked out where the
    first test fails."""
    key = key_of(listing, manifest)
    now, was = _sides(listing, manifest)
    both = now.join(was, key, "full_outer")
    same = (F.col("now.size_bytes") == F.col("was.size_bytes")) & (F.col("now.mtime") == F.col("was.mtime"))
    equal = F.col("now.content_sha256") == F.col("was.content_sha256")
    action = F.when(F.col("here").isNull(), "delete").when(F.col("known").isNull(), "index").when(F.lit(not verify) & same, "skip").when(equal & same, "skip").when(equal, "touch").otherwise("index")
    return both.select(*key, action.alias("action"), *(F.col(f"now.{c}").alias(c) for c in _STATE))


def deleted_paths(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Keys of the manifest that aren't listed any more."""
    key = key_of(listing, manifest)
    return manifest.select(*key).join(listing.select(*key), key, "left_anti")


def sync_paths(dirty: DataFrame, listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Actions for the keys of ``dirty`` alone: ``index``, ``touch``, ``delete``, or ``ignore`` for a key that neither
    table has.  There is no shortcut by size and time."""
    key = key_of(dirty, listing, manifest)
    now, was = _sides(listing, manifest)
    both = dirty.select(*key).distinct().join(now, key, "left").join(was, key, "left")
    here, known = F.col("here").isNotNull(), F.col("known").isNotNull()
    action = F.when(here & known & (F.col("now.content_sha256") == F.col("was.content_sha256")), "touch").when(here, "index").when(known, "delete").otherwise("ignore")
    return both.select(*key, action.alias("action"), *(F.col(f"now.{c}").alias(c) for c in _STATE))


def touch_manifest(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """A10: the manifest with size, time and hash of ``changes``, by key; absent keys are added."""
    key = key_of(manifest, changes)
    new = changes.select(*key, *(F.col(c).alias(f"new_{c}") for c in _STATE))
    both = manifest.join(new, key, "full_outer")
    return both.select(*key, *(F.coalesce(f"new_{c}", c).alias(c) for c in _STATE))


def next_manifest(manifest: DataFrame, diff: DataFrame) -> DataFrame:
    """The manifest after a sync: what was deleted goes, what was indexed or touched is as listed."""
    key = key_of(manifest, diff)
    left = manifest.join(diff.filter("action = 'delete'").select(*key), key, "left_anti")
    return touch_manifest(left, diff.filter("action in ('index', 'touch')"))


def upsert_documents(base: DataFrame, new: DataFrame) -> DataFrame:
    """``base`` with the documents of ``new`` in place of those with the same key."""
    key = key_of(base, new)
    return base.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def check_counts(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, n_vectors) of documents whose numbers differ; an upsert is refused if there is any."""
    a, b = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks")), vectors.groupBy("doc_id").agg(F.count("*").alias("n_vectors"))
    both = a.join(b, "doc_id", "full_outer").select("doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"))
    return both.filter("n_chunks <> n_vectors")


def delete_documents(base: DataFrame, gone: DataFrame) -> DataFrame:
    """``base`` without the keys of ``gone``; keys that aren't there change nothing."""
    key = key_of(base, gone)
    return base.join(gone.select(*key).distinct(), key, "left_anti")


def cascade_delete(docs: DataFrame, gone: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """``docs`` and every table with ``doc_id``, without the documents of ``gone`` (keys)."""
    key = key_of(docs, gone)
    ids = docs.join(gone.select(*key).distinct(), key, "left_semi").select("doc_id")
    return [delete_documents(docs, gone), *(t.join(ids, "doc_id", "left_anti") for t in tables)]


def sync_summary(diff: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(source_name, indexed, deleted, skipped, failed); a touch counts as skipped, a failed key as failed only."""
    rows = diff if failed is None else diff.join(failed.select(*key_of(diff, failed), F.lit(True).alias("failed")), key_of(diff, failed), "left")
    bad = F.coalesce(F.col("failed"), F.lit(False)) if failed is not None else F.lit(False)
    n = lambda *a: F.count_if(~bad & F.col("action").isin(*a))
    return rows.groupBy("source_name").agg(n("index").alias("indexed"), n("delete").alias("deleted"), n("skip", "touch").alias("skipped"), F.count_if(bad).alias("failed"))


def managed_documents(writes: DataFrame, kb: Column) -> DataFrame:
    """Documents of the reserved source for ``writes`` (key, ts, title, content, metadata)."""
    path = memory_id(F.col("ts"), F.col("key"))
    docs = writes.withColumns({"kb": kb, "rel_path": path})
    return docs.select(
        "kb", F.lit(MANAGED).alias("source_name"), "rel_path", render_uri(F.lit("managed"), F.col("kb"), F.lit(""), F.col("rel_path")).alias("uri"),
        F.coalesce(F.nullif("title", F.lit("")), "rel_path").alias("title"), "content", content_hash(F.col("content")).alias("content_sha256"),
        F.octet_length("content").cast("long").alias("size_bytes"), F.col("ts").alias("mtime"), "metadata",
    )


def writable_guard(writes: DataFrame, kbs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``) of ``writes`` (kb, content, ...); ``kbs`` has (kb, writable)."""
    known = writes.join(kbs.select("kb", "writable"), "kb", "left")
    blank = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " ")) == ""
    reason = F.when(F.col("writable").isNull(), "unknown knowledge base").when(~F.col("writable"), "not writable").when(blank, "blank content")
    marked = known.withColumn("reason", reason).drop("writable")
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def check_identity(meta: DataFrame, model: str, dim: int) -> DataFrame:
    """One row (embedding_model, embedding_dimensions): the given identity if ``meta`` is empty; if it has another one,
    reading the result is an error, never a wipe."""
    given = meta.sparkSession.createDataFrame([(model, dim)], "model string, dim int")
    both = given.join(F.broadcast(meta.limit(1)), how="left")
    bad = F.col("embedding_model").isNotNull() & ((F.col("embedding_model") != F.col("model")) | (F.col("embedding_dimensions") != F.col("dim")))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("index was built with "), F.col("embedding_model"))).cast("string")).otherwise(F.col("model"))
    return both.select(checked.alias("embedding_model"), F.col("dim").alias("embedding_dimensions"))
