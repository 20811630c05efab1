
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import base_title, chunk_id, document_id, file_ext, format_of, metadata_matches, relevance, trim_all
from ..operators import chunking, evaluate, extract, keyword, ranking, sync
from ..operators.results import ModelResults, contextualize_once, embed_once
from ..sources import written
from .index import Index, sent

#: Options of a query where it gives none.
DEFAULTS = {"limit": ranking.LIMIT, "min_score": 0.0, "rerank": False, "max_per_doc": ranking.MAX_PER_DOC}


def with_defaults(queries: DataFrame) -> DataFrame:
    """``queries`` (query_id, query, query_vec or null) with every option of a search: ``limit``, ``min_score``, ``rerank``,
    ``max_per_doc`` and ``filter``."""
    out = queries
    for name, value in DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in queries.columns else F.lit(value))
    if "filter" not in queries.columns:
        out = out.withColumn("filter", F.lit(None).cast("map<string,string>"))
    return out if "query_vec" in queries.columns else out.withColumn("query_vec", F.lit(None).cast("array<float>"))


def candidates(queries: DataFrame, index: Index, prefilter: bool = False) -> tuple[DataFrame, DataFrame]:
    """The two legs of a search, ranked, 50 for each query; with ``prefilter`` 50 that pass the query's metadata filter.  Of an
    index by knowledge base queries (with a column ``kb``) see that knowledge base alone."""
    if index.by_kb != ("kb" in queries.columns):
        raise ValueError("queries and index must both have a column kb, or neither")
    by = "kb" if index.by_kb else None
    tables = index.postings, index.lengths, index.stats, index.terms
    if not prefilter:
        return ranking.ranked(keyword.best(queries, *tables, ranking.CANDIDATES), "bm25", "fts_rank", ranking.CANDIDATES), ranking.knn_cosine(queries, index.vectors, by=by)
    as_text = F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("filter")))), F.lit("{}"))
    asked = queries.withColumn("seen", F.concat_ws(keyword.KB_END, *([by] if by else []), as_text))
    allowed = visible(asked.select("seen", "filter", *([by] if by else [])).dropDuplicates(["seen"]), index)
    words = keyword.bm25(queries, *tables).join(asked.select("query_id", "seen"), "query_id").join(allowed, ["seen", "chunk_id"])
    words = ranking.ranked(words.select("query_id", "chunk_id", "bm25"), "bm25", "fts_rank", ranking.CANDIDATES)
    return words, ranking.knn_cosine(asked, index.vectors.join(allowed, "chunk_id"), by="seen")


def visible(filters: DataFrame, index: Index) -> DataFrame:
    """(seen, chunk_id): the chunks whose documents pass each of ``filters`` (seen, filter, and ``kb`` of an index by it).

    A filter is looked up by one pair of key and value among those of the documents and then tested in full; only filters
    without such a pair, which ask for nothing or for missing keys, are compared with every document."""
    kb = ["kb"] if index.by_kb else []
    pair = F.get(F.filter(F.map_entries("filter"), lambda e: e.value != ""), F.lit(0))
    asked = filters.withColumn("pair", pair)
    docs = index.docs.select("doc_id", "metadata", *kb)
    passes = metadata_matches(F.col("metadata"), F.col("filter"))
    entries = docs.select("*", F.explode("metadata").alias("key", "value"))
    known = asked.filter("pair is not null").select("*", F.col("pair.key").alias("key"), F.col("pair.value").alias("value"))
    found = known.join(entries, ["key", "value", *kb]).filter(passes).select("seen", "doc_id")
    rest = asked.filter("pair is null").select("seen", "filter", *kb)
    found = found.union((docs.join(rest, kb) if kb else docs.join(F.broadcast(rest))).filter(passes).select("seen", "doc_id"))
    return found.join(index.chunks.select("chunk_id", "doc_id"), "doc_id").select("seen", "chunk_id")


def search(queries: DataFrame, index: Index, scorer: Callable[[list[str], list[str]], list[float]] | Column | None = None, prefilter: bool = False) -> DataFrame:
    """L1: hits (query_id, rank, relevance, rrf, fts_rank, vec_rank, chunk and document columns) for all ``queries`` at once.

    Ranks are worked out on ids alone; chunk and document columns are fetched for what is left after the cut to
    ``fetch_k``.  The metadata filter comes after retrieval (with ``prefilter`` before it, so that it doesn't cost hits), the
    cap after reranking, the least score after the limit.  Without ``scorer`` no query is reranked."""
    asked = with_defaults(queries)
    options = asked.select("query_id", "query", "limit", "min_score", (F.col("rerank") & F.lit(scorer is not None)).alias("rerank"), "max_per_doc", "filter")
    fused = ranking.fused_rank(ranking.rrf_fuse(*candidates(asked, index, prefilter))).join(options, "query_id")
    cut = fused.filter(F.col("rank") <= ranking.fetch_k(F.col("limit"), F.col("rerank"), F.col("max_per_doc")))
    hits = ranking.hydrate_hits(cut, index.chunks, index.docs).filter(metadata_matches(F.col("metadata"), F.col("filter")))
    hits = hits.withColumn("relevance", relevance(F.col("rrf")))
    if scorer is not None:
        plain = hits.filter(~F.col("rerank"))
        hits = plain.unionByName(ranking.rerank(hits.filter("rerank"), scorer).select(*plain.columns))
    return ranking.above_min_score(ranking.limited(ranking.cap_per_document(hits))).drop("filter", "min_score", "rerank", "max_per_doc")


def search_all(queries: DataFrame, index: Index, scorer=None, prefilter: bool = False) -> DataFrame:
    """L2: ``search`` in every knowledge base (column ``kb`` of the documents) at once, merged by relevance: each query is asked
    once for each of them, in one plan, and meets the postings and vectors of each once."""
    kbs = index.docs.select("kb").distinct()
    asked = kbs.join(F.broadcast(queries)) if queries.count() <= keyword.SMALL else queries.join(kbs)  # every query, every knowledge base
    asked = asked.withColumn("asked_id", F.concat("kb", F.lit(keyword.KB_END), F.col("query_id").cast("string")))
    of = asked.select(F.col("asked_id"), F.col("query_id").alias("own_id"))
    hits = search(asked.drop("query_id").withColumnRenamed("asked_id", "query_id"), index, scorer, prefilter)
    back = hits.withColumnRenamed("query_id", "asked_id").join(of, "asked_id").drop("asked_id").withColumnRenamed("own_id", "query_id")
    return ranking.merge_by_relevance(back)


def extract_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs`` (doc_id, rel_path, text) by format; markdown by sections, everything else whole."""
    sections, whole = _by_format(docs)
    return sections.unionByName(whole)


def _by_format(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of markdown, and of the others, which are one block each."""
    kind = docs.withColumn("format", format_of(file_ext(F.col("rel_path"))))
    return extract.markdown_blocks(kind.filter("format = 'markdown'")), extract.whole_file_block(kind.filter("format <> 'markdown'"))


def index_documents(docs: DataFrame, embed: Callable[[list[str]], np.ndarray], dim: int, contextualizer=None, max_tokens: int = chunking.MAX_TOKENS, overlap: int = chunking.OVERLAP, embeddings: ModelResults | None = None, contexts: ModelResults | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors) of ``docs`` (doc_id, rel_path, title, text).

    Both are tables in the shared folder: documents are read and cut once, a chunk's context is made once and is the one that
    is embedded.  With ``embeddings`` or ``contexts`` the models are asked only for what isn't stored there."""
    sections, whole = _by_format(docs)
    chunks = chunking.chunk_blocks(sections, max_tokens, overlap).unionByName(chunking.chunk_whole_files(whole, max_tokens, overlap))
    if contextualizer and contexts:
        chunks = contextualize_once(written(chunks, "cut"), docs, contextualizer, contexts)
    else:
        chunks = chunking.contextualize_chunks(chunks, docs, contextualizer) if contextualizer else chunks.withColumn("context", F.lit(""))
    chunks = written(chunks.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("seq"))), "chunks", "zstd")
    texts = chunking.with_embedding_text(chunks)
    made = embed_once(texts, embed, dim, embeddings) if embeddings else chunking.embed_texts(texts, embed, dim)
    return chunks, written(ranking.read_embeddings(made.select("chunk_id", "embedding"), dim), "vectors")


@dataclass(frozen=True)
class Base:
    """A knowledge base's tables: documents (key, doc_id, ...), chunks, vectors (chunk_id, embedding, norm) and manifest."""

    docs: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    manifest: DataFrame


def _replaced(base: Base, gone: DataFrame, docs: DataFrame, chunks: DataFrame, vectors: DataFrame, manifest: DataFrame) -> Base:
    """``base`` without the documents of ``gone`` (keys) and what hangs on them, with the new rows."""
    left, kept = sync.cascade_delete(base.docs, gone, base.chunks)
    held = base.vectors.join(kept.select("chunk_id"), "chunk_id", "left_semi")
    return Base(left.unionByName(docs.select(*left.columns)), kept.unionByName(chunks.select(*kept.columns)), held.unionByName(vectors.select(*held.columns)), manifest)


@dataclass(frozen=True)
class Changes:
    """What a sync found: ``diff`` without the keys that failed, the new documents, chunks and vectors, the keys whose old rows
    go, and the keys that failed with the reason (``error``)."""

    diff: DataFrame
    docs: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    gone: DataFrame
    failed: DataFrame


def changes(diff: DataFrame, contents: Callable[[DataFrame], DataFrame], embed, dim: int, contextualizer=None, **cut) -> Changes:
    """Reads, extracts, cuts and embeds what ``diff`` says is to be indexed.

    ``contents`` takes keys and returns them with ``text`` and, if it likes, ``error``.  A document with an error, without a
    text or with a line beyond the limit fails alone: it is left out here and has its reason in ``failed``.  An error of a
    model ends the job; nothing is half done then, because callers store the result as a whole."""
    key = sync.key_of(diff)
    wanted = written(diff.filter("action = 'index'").select(*key), "wanted")
    got = contents(sent(wanted))
    error = F.col("error") if "error" in got.columns else F.lit(None).cast("string")
    got = got.select(*key, "text", error.alias("error"))
    reason = F.coalesce("error", F.when(F.col("text").isNull(), "cannot be read"), F.when(extract.has_overlong_line(F.col("text")), "a line is too long"))
    read = written(wanted.join(got, key, "left").withColumn("error", reason), "contents", "zstd")
    failed = read.filter("error is not null").select(*key, "error")
    texts = read.filter("error is null").select(*key, "text")
    docs = texts.withColumns({"doc_id": document_id(*key), "title": base_title(F.col("rel_path"))})
    chunks, vectors = index_documents(docs, embed, dim, contextualizer, **cut)
    left = diff.join(failed.select(*key), key, "left_anti")
    return Changes(left, docs.drop("text"), chunks, vectors, left.filter("action in ('index', 'delete')").select(*key), failed)


def _applied(diff: DataFrame, base: Base, manifest: DataFrame, contents: Callable[[DataFrame], DataFrame], embed, dim: int, contextualizer=None, **cut) -> tuple[Base, Changes]:
    made = changes(diff, contents, embed, dim, contextualizer, **cut)
    return _replaced(base, made.gone, made.docs, made.chunks, made.vectors, sync.next_manifest(manifest, made.diff)), made


def sync_source(listing: DataFrame, base: Base, contents: Callable[[DataFrame], DataFrame], embed, dim: int, contextualizer=None, verify: bool = False, **cut) -> tuple[Base, DataFrame]:
    """L4: (tables after a sync, summary) of a source: changed documents are read by ``contents`` (see ``changes``), extracted,
    cut, embedded and put in place of their old rows; those that aren't listed any more go.

    Failed documents keep their old rows and their old row in the manifest, so the next sync tries them again, and are counted.
    A document that became blank loses its chunks, its manifest row stays.  The tables of ``base`` aren't touched: the result
    is stored as a whole or, after an error of a model, not at all."""
    manifest = sync.read_manifest(base.manifest, base.chunks)
    diff = sync.manifest_diff(listing, manifest, verify)
    after, made = _applied(diff, base, manifest, contents, embed, dim, contextualizer, **cut)
    return after, sync.sync_summary(diff, made.failed)


def sync_paths(dirty: DataFrame, listing: DataFrame, base: Base, contents: Callable[[DataFrame], DataFrame], embed, dim: int, contextualizer=None, **cut) -> tuple[Base, DataFrame]:
    """As ``sync_source`` for the keys of ``dirty`` alone: (tables, actions)."""
    diff = sync.sync_paths(dirty, listing, base.manifest)
    return _applied(diff, base, base.manifest, contents, embed, dim, contextualizer, **cut)[0], diff


def sync_index(listing: DataFrame, index: Index, manifest: DataFrame, contents: Callable[[DataFrame], DataFrame], embed, dim: int, contextualizer=None, verify: bool = False, **cut) -> tuple[Index, DataFrame, DataFrame]:
    """L4 on a stored index: (index with one more segment, next manifest, summary).  Postings, lengths and statistics follow
    the documents; only what changed is read, tokenised and embedded.  Columns of documents that the sync doesn't know are
    null."""
    manifest = sync.read_manifest(manifest, index.chunks)
    diff = written(sync.manifest_diff(listing, manifest, verify), "diff")
    made = changes(diff, contents, embed, dim, contextualizer, **cut)
    key = sync.key_of(index.docs, made.gone)
    gone = index.docs.join(made.gone, key, "left_semi").select("doc_id")
    return index.updated(gone, _shaped(made.docs, index.docs), _shaped(made.chunks, index.chunks), made.vectors), sync.next_manifest(manifest, made.diff), sync.sync_summary(diff, made.failed)


def _shaped(new: DataFrame, like: DataFrame) -> DataFrame:
    return new.select(*((F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema))


def rebuild(listing: DataFrame, base: Base, contents: Callable[[DataFrame], DataFrame], embed, dim: int, contextualizer=None, **cut) -> tuple[Base, DataFrame]:
    """A sync from nothing: every listed key is indexed, whatever the tables held."""
    empty = Base(*(t.limit(0) for t in (base.docs, base.chunks, base.vectors, base.manifest)))
    return sync_source(listing, empty, contents, embed, dim, contextualizer, **cut)


def store_documents(writes: DataFrame, kbs: DataFrame, base: Base, embed, dim: int, **cut) -> tuple[Base, DataFrame]:
    """(tables with agent-written texts in them, rejected writes); such texts get no context.  The documents of ``base``
    have a column ``kb``; its manifest isn't touched."""
    ok, rejected = sync.writable_guard(writes, kbs)
    docs = sync.managed_documents(ok, F.col("kb")).withColumn("doc_id", document_id("kb", "source_name", "rel_path"))
    texts = docs.select("doc_id", F.concat("rel_path", F.lit(".md")).alias("rel_path"), "title", F.col("content").alias("text"))
    chunks, vectors = index_documents(texts, embed, dim, **cut)
    return _replaced(base, docs.select("kb", "source_name", "rel_path"), docs, chunks, vectors, base.manifest), rejected


def delete_managed(docs: DataFrame, kbs: DataFrame, ids: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Documents of the reserved source with the keys of ``ids`` (kb, rel_path) go, with their rows in ``tables``; only in
    the knowledge base that is named, and only if it can be written."""
    allowed = ids.join(kbs.filter("writable").select("kb"), "kb", "left_semi").select("kb", F.lit(sync.MANAGED).alias("source_name"), "rel_path")
    return sync.cascade_delete(docs, allowed, *tables)


def run_evaluation(golden: DataFrame, index: Index, top_n: int = 5, scorer=None, rerank: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rank of each golden query, summary)."""
    asked = golden.withColumns({"limit": F.lit(4 * top_n), "rerank": F.lit(rerank)})
    ranks = evaluate.doc_rank(golden, search(asked, index, scorer), top_n)
    return ranks, evaluate.recall_mrr(ranks)


def compare_runs(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(differences of the summaries b - a, queries whose rank changed) of two evaluations' ranks."""
    x, y = evaluate.recall_mrr(a), evaluate.recall_mrr(b)
    both = x.select(*(F.col(c).alias(f"{c}_a") for c in x.columns)).join(F.broadcast(y))
    return both.select(*((F.col(c) - F.col(f"{c}_a")).alias(c) for c in ("recall_at_1", "recall_at_n", "mrr"))), evaluate.eval_deltas(a, b)


def parity(golden: DataFrame, new: DataFrame, legacy: DataFrame, n: int = 5) -> DataFrame:
    """The gate over two systems' hits."""
    return evaluate.parity_gate(evaluate.parity_compare(golden, new, legacy, n))


def is_blank(text: Column) -> Column:
    return trim_all(F.coalesce(text, F.lit(""))) == ""
