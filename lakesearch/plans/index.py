"""

A stored index is a folder of segments.  The first holds everything; an update adds one with what is new and the ids of what is
gone, and costs as much as what changed: only changed documents are tokenised, old texts among them, to take their counts
back.  Numbers of chunks and tokens and the document frequencies of terms are kept by signed differences, so they are sums
over segments.  ``merged`` makes one segment of all.  A segment is there once its row in ``segments`` is; that row is written
last, so a failed update leaves nothing that is read.  An index has one writer at a time.

Ids of chunks that are strings are long next to a posting: postings and lengths have a number (``chunk_no``) for them, which
grows from segment to segment.  Ids of what is gone are sent to the tables up to ``SENT`` of them, so that texts and postings
aren't shuffled for them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators import keyword
from ..sources import drop, written

#: Ids up to which their table is broadcast, about 100 MB.
SENT = 1 << 20


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def sent(ids: DataFrame) -> DataFrame:
    """``ids``, which are stored, broadcast if there are few enough."""
    return F.broadcast(ids) if ids.count() <= SENT else ids


class Index:
    """Documents (doc_id, source_name, rel_path, metadata, ...), chunks (chunk_id, doc_id, text, ...), vectors (chunk_id,
    embedding, norm), postings, chunk lengths, and of a stored index ``stats`` (n_chunks, avgdl) and ``terms`` (term, df).

    Where documents have a column ``kb`` so have vectors and lengths, postings and terms carry it, and a search stays within a
    knowledge base."""

    TABLES = ("docs", "chunks", "vectors", "lengths")
    #: The column by which an older segment's rows are taken out.
    KEYS = {"docs": "doc_id", "chunks": "chunk_id", "vectors": "chunk_id", "lengths": "chunk_id", "postings": "chunk_id"}

    def __init__(self, docs: DataFrame, chunks: DataFrame, vectors: DataFrame, postings: DataFrame | None = None, lengths: DataFrame | None = None, stats: DataFrame | None = None, terms: DataFrame | None = None, path: str | None = None, packs: DataFrame | None = None):
        self.docs, self.chunks, self.path, self.stats, self.terms = docs, chunks, path, stats, terms
        #: Postings as they are stored, where nothing of a segment is gone or that is few enough to be sent.
        self.packs = packs
        self.by_kb = "kb" in docs.columns
        rows = chunks
        if self.by_kb and (postings is None or lengths is None or "kb" not in vectors.columns):
            rows = chunks.join(docs.select("doc_id", "kb"), "doc_id")
        self.vectors = vectors if not self.by_kb or "kb" in vectors.columns else vectors.join(rows.select("chunk_id", "kb"), "chunk_id")
        #: What both are made of; kept only if neither was given.
        self.tokens = keyword.tokens(rows) if postings is None and lengths is None else None
        self.postings = keyword.postings(rows) if postings is None else postings
        self.lengths = keyword.chunk_lengths(rows) if lengths is None else lengths

    def write(self, path: str) -> Index:
        """The index stored below ``path`` as one segment and read from there: built once, searched many times."""
        _add_segment(self.docs.sparkSession, path, 0, self, None, None, True)
        return Index.read(self.docs.sparkSession, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        live = _segments(spark, path)
        at = [f"{path}/{r.name}" for r in live]
        gone = [spark.read.parquet(f"{a}/gone") if r.seq and not r.whole else None for a, r in zip(at, live, strict=True)]
        few = [g is None or g.count() <= SENT for g in gone]
        schema = spark.read.parquet(f"{at[0]}/lengths").schema
        by = "chunk_no" if "chunk_no" in schema.names else "chunk_id"
        keys, id_type = cls.KEYS | {"postings": by, "lengths": by}, schema[by].dataType.simpleString()

        def left(i: int, name: str, rows: DataFrame) -> DataFrame:
            """``rows`` of a table of segment ``i`` without what went later."""
            for g, small in zip(gone[i + 1 :], few[i + 1 :], strict=True):
                ids = g.select(keys[name]).filter(f"{keys[name]} is not null")
                rows = rows.join(F.broadcast(ids) if small else ids, keys[name], "left_anti")
            return rows

        table = lambda name: _union([left(i, name, spark.read.parquet(f"{a}/{name}")) for i, a in enumerate(at)])
        packs = [keyword.stored_packs(spark, f"{a}/postings", id_type) for a in at]
        postings = _union([left(i, "postings", keyword.unpacked(p, by)) for i, p in enumerate(packs)])
        # rows of a pack stay together where ids are sent to them
        packs = _union([(keyword.packed(left(i, "postings", keyword.unpacked(p, by))) if i + 1 < len(at) else p).select(*keyword.PACK) for i, p in enumerate(packs)]) if all(few) else None
        sums = _union([spark.read.parquet(f"{a}/sums") for a in at])
        stats = sums.groupBy(*keyword._kb(sums)).agg(F.sum("n_chunks").alias("n_chunks"), F.try_divide(F.sum("n_tokens"), F.sum("n_chunks")).alias("avgdl")).filter("n_chunks > 0")
        terms = _union([spark.read.schema("term string, df long, h long, bucket int").parquet(f"{a}/terms") for a in at])
        return cls(*(table(n) for n in ("docs", "chunks", "vectors")), postings, table("lengths"), stats, terms, path, packs)

    def updated(self, gone: DataFrame, docs: DataFrame, chunks: DataFrame, vectors: DataFrame, tag: str | None = None) -> Index:
        """The stored index after the documents of ``gone`` (doc_id) went and the given ones came, as one more segment.
        Documents may be in both; ids of documents that aren't there change nothing.  An update whose ``tag`` (for example a
        stream's name and the number of its batch) the index already has is not done again."""
        spark = self.docs.sparkSession
        if tag is not None and not spark.read.parquet(f"{self.path}/segments").filter(F.col("tag") == tag).isEmpty():
            return Index.read(spark, self.path)
        new = Index(docs.select(*self.docs.columns), chunks.select(*self.chunks.columns), vectors)
        old_docs = self.docs.join(gone.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", *keyword._kb(self.docs))
        ids = written(old_docs.join(self.chunks.select("doc_id", "chunk_id"), "doc_id", "left"), "gone")
        if "chunk_no" in self.lengths.columns:
            ids = written(ids.join(self.lengths.select("chunk_id", "chunk_no"), "chunk_id", "left"), "gone")
        _add_segment(spark, self.path, _segments(spark, self.path)[-1].seq + 1, new, self, ids, False, tag)
        return Index.read(spark, self.path)

    def merged(self) -> Index:
        """The stored index with all its segments made one; older ones aren't read any more."""
        spark = self.docs.sparkSession
        _add_segment(spark, self.path, _segments(spark, self.path)[-1].seq + 1, self, None, None, True)
        return Index.read(spark, self.path)


def _segments(spark: SparkSession, path: str) -> list:
    """Rows (seq, name, whole) of the segments that are read, in order: the last one that holds everything and those after it."""
    rows = sorted(spark.read.parquet(f"{path}/segments").collect(), key=lambda r: r.seq)  # a few
    return rows[max(i for i, r in enumerate(rows) if r.whole) :]


def _add_segment(spark: SparkSession, path: str, seq: int, new: Index, old: Index | None, gone: DataFrame | None, whole: bool, tag: str | None = None) -> None:
    """``old`` is the index of which ``gone`` (doc_id, chunk_id, and chunk_no where it has that) goes."""
    name = f"segment-{seq:06d}-{uuid.uuid4().hex[:8]}"
    at = f"{path}/{name}"
    postings, common, made, tokens = new.postings, None, {t: getattr(new, t) for t in Index.TABLES}, new.tokens
    if tokens is not None:  # texts are tokenised once
        if isinstance(tokens.schema["chunk_id"].dataType, StringType) and (old is None or "chunk_no" in old.lengths.columns):
            tokens = keyword.numbered(tokens, -1 if old is None else old.lengths.agg(F.coalesce(F.max("chunk_no"), F.lit(-1))).first()[0])
        tokens = written(tokens, "tokens", "zstd")
        postings, common, made["lengths"] = keyword.packs_of(tokens), keyword.common_terms(tokens), keyword.lengths_of(tokens)
    elif new.terms is not None:  # segments that become one: the postings are dealt without a look at them first
        postings, common = new.postings if new.packs is None else new.packs, keyword.known_common_terms(new.terms)
    for t in Index.TABLES:
        _write(made[t], f"{at}/{t}")
    lengths = spark.read.parquet(f"{at}/lengths")
    n_tokens = lengths.agg(F.sum("n_tokens")).first()[0] or 0
    keyword.store(postings.drop("h", "bucket"), f"{at}/postings", n_tokens, common)
    if tokens is not None:  # as large as the texts
        drop(tokens)
    terms = keyword.stored_counts(spark, f"{at}/postings")
    sums = keyword.length_sums(lengths)
    if gone is not None:
        _write(gone, f"{at}/gone")
        minus = lambda df, *cs: df.withColumns({c: -F.col(c) for c in cs})
        by = keyword._id(old.lengths)
        of = lambda rows, key: rows.join(sent(gone.select(key).filter(f"{key} is not null")), key, "left_semi")
        sums = sums.unionByName(minus(keyword.length_sums(of(old.lengths, by)), "n_chunks", "n_tokens"))
        texts = of(old.chunks, "chunk_id")
        if old.by_kb:
            texts = texts.join(sent(gone.select("doc_id", "kb").distinct()), "doc_id")
        lost = minus(keyword.counts_of(keyword.tokens(texts)), "df")
        terms = terms.unionByName(lost).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
    sums.write.parquet(f"{at}/sums")
    keyword.store_terms(terms, f"{at}/terms", n_tokens)
    spark.createDataFrame([(seq, name, whole, tag)], "seq int, name string, whole boolean, tag string").coalesce(1).write.mode("append").parquet(f"{path}/segments")


def _write(table: DataFrame, path: str) -> None:
    table.write.parquet(path, compression="zstd")
