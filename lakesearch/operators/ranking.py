"""

Scores are compared after rounding to nine decimals and ties go to the smaller id, so ranks don't depend on the order in
which sums are built.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import RRF_K, norm, relevance, sigmoid
from ..sources import written

CANDIDATES, POOL, LIMIT, MAX_PER_DOC = 50, 24, 8, 2
#: Query vectors in a block and vectors in a part, which meet in one task (with 1,024 dimensions: 16 MB and 64 MB).
BLOCK, PART = 4096, 16384
#: Groups up to which their table of sizes may be broadcast.
GROUPS = 100_000
#: Scores that a matrix product makes at once (32 MB).
CELLS = 1 << 22
PLACES = 9


def read_embeddings(vectors: DataFrame, dim: int) -> DataFrame:
    """``vectors`` (chunk_id, embedding) with ``norm``; a vector that doesn't have ``dim`` elements is an error."""
    checked = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("vector of wrong dimension: "), F.col("chunk_id").cast("string"))).cast("array<float>"))
    return vectors.select("chunk_id", checked.alias("embedding")).withColumn("norm", norm(F.col("embedding")))


def _best(score: str, *ties: str) -> list[Column]:
    return [F.round(score, PLACES).desc(), *(F.col(t).asc() for t in ties)]


def ranked(scores: DataFrame, score: str, rank: str, k: int | None = None) -> DataFrame:
    """F1, F2, G1: with ``rank`` by query, best first; only ranks up to ``k``, which Spark cuts before the shuffle too."""
    out = scores.withColumn(rank, F.row_number().over(W.partitionBy("query_id").orderBy(*_best(score, "chunk_id"))))
    return out if k is None else out.filter(F.col(rank) <= k)


def knn_cosine(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, block: int = BLOCK, part: int = PART, by: str | None = None) -> DataFrame:
    """(query_id, chunk_id, cosine, vec_rank), the ``k`` nearest of ``vectors`` (chunk_id, embedding, norm) for
    each of ``queries`` (query_id, query_vec), exactly.  With ``by``, a column of both, queries only meet vectors of their own
    group.

    Queries are dealt to blocks and vectors to parts of bounded size within each group; every block meets every part of its
    group once, in one task, as a matrix product of at most ``CELLS`` scores at a time.  A meeting keeps ``k`` candidates for
    each query, so all pairs never exist as rows, and no vector passes through the driver.  Vectors and queries without
    length have no neighbours."""
    group = F.col(by) if by else F.lit("")
    asked = queries.filter(F.col("query_vec").isNotNull()).select("query_id", "query_vec", group.alias("g"))
    known = vectors.filter("norm > 0").select("chunk_id", "embedding", "norm", group.alias("g"))
    pieces = lambda n, size: (F.lit(1) + F.floor((n - 1) / size)).cast("int")
    shape = asked.groupBy("g").agg(pieces(F.count("*"), block).alias("blocks")).join(known.groupBy("g").agg(pieces(F.count("*"), part).alias("parts")), "g")
    shape = written(shape, "knn_groups")  # a row for each group
    shape = F.broadcast(shape) if shape.count() <= GROUPS else shape
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(shape, "g").select("g", deal("query_id", "blocks").alias("b"), all_of("parts").alias("p"), "query_id", "query_vec")
    right = known.join(shape, "g").select("g", all_of("blocks").alias("b"), deal("chunk_id", "parts").alias("p"), "chunk_id", "embedding", "norm")
    types = queries.schema["query_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()
    key = ["g", "b", "p"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda q, v: _nearest(q, v, k), f"query_id {types[0]}, chunk_id {types[1]}, cosine double")
    return ranked(met, "cosine", "vec_rank", k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """Candidates (query_id, chunk_id, cosine) of a block of queries among a part of the vectors."""
    names, found = ["query_id", "chunk_id", "cosine"], []
    if queries.num_rows and vectors.num_rows:
        q = _matrix(queries["query_vec"]).astype(np.float64)
        size = np.sqrt((q * q).sum(axis=1))
        ids, q = queries["query_id"].take(pa.array(np.flatnonzero(size))), q[size > 0] / size[size > 0, None]
        step = max(1, CELLS // max(1, len(q)))
        for at in range(0, vectors.num_rows if len(q) else 0, step):
            v = vectors.slice(at, step)
            scores = (q @ _matrix(v["embedding"]).astype(np.float64).T) / v["norm"].to_numpy()[None, :]
            keep = np.ones_like(scores, bool)
            if v.num_rows > k:
                # everything at the k-th score or above stays, so ties are settled by id later
                keep = scores >= (-np.partition(-scores, k - 1, axis=1)[:, k - 1])[:, None] - 2 * 10.0**-PLACES
            i, j = np.nonzero(keep)
            found.append(pa.table([ids.take(pa.array(i)), v["chunk_id"].take(pa.array(j)), pa.array(scores[i, j])], names))
    if found:
        return pa.concat_tables(found)
    return pa.table([queries["query_id"].slice(0, 0), vectors["chunk_id"].slice(0, 0), pa.array([], pa.float64())], names)


def rrf_fuse(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rrf, fts_rank, vec_rank) from the two ranked legs; an absent rank is 0.

    A union and one group: one shuffle instead of the two of an outer join."""
    legs = keyword.select("query_id", "chunk_id", "fts_rank", F.lit(0).alias("vec_rank")).union(vector.select("query_id", "chunk_id", F.lit(0), "vec_rank"))
    part = lambda r: F.when(F.col(r) > 0, 1.0 / (RRF_K + F.col(r))).otherwise(0.0)
    out = legs.groupBy("query_id", "chunk_id").agg(F.max("fts_rank").alias("fts_rank"), F.max("vec_rank").alias("vec_rank"))
    return out.select("query_id", "chunk_id", (part("fts_rank") + part("vec_rank")).alias("rrf"), "fts_rank", "vec_rank")


def fetch_k(limit: Column, reranks: Column, max_per_doc: Column) -> Column:
    """The limit, widened if reranking or capping may drop hits."""
    return F.when(reranks | (max_per_doc > 0), F.greatest(4 * limit, F.lit(POOL))).otherwise(limit)


def fused_rank(fused: DataFrame) -> DataFrame:
    """with ``rank`` by fused score."""
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*_best("rrf", "chunk_id"))))


def hydrate_hits(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """D3: ``hits`` with the columns of their chunks and documents; texts are fetched for hits only.

    Hits are written to the shared folder first: Spark then knows their size and sends few hits to the texts, which would
    all be shuffled otherwise."""
    return written(hits, "hits").join(chunks, "chunk_id").join(docs, "doc_id")


def cap_per_document(hits: DataFrame, order: str = "rank") -> DataFrame:
    """at most ``max_per_doc`` (a column; negative: no cap) hits of one document in a query, best first."""
    place = F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy(order))
    return hits.withColumn("of_doc", place).filter("max_per_doc < 0 or of_doc <= max_per_doc").drop("of_doc")


def renumbered(hits: DataFrame, order: str = "rank") -> DataFrame:
    """``order`` made consecutive again by query."""
    return hits.withColumn(order, F.row_number().over(W.partitionBy("query_id").orderBy(order)))


def rerank_pool(hits: DataFrame, size: int = POOL) -> DataFrame:
    """the first ``size`` of a query, with ``pool_idx`` from 0."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank")) - 1
    return hits.withColumn("pool_idx", place).filter(F.col("pool_idx") < size)


def needs_sigmoid(score: Column) -> Column:
    """Is any score of a query's rerank outside [0, 1]?"""
    return F.max((score < 0) | (score > 1)).over(W.partitionBy("query_id"))


def rerank_order(scores: DataFrame) -> DataFrame:
    """``scores`` (query_id, chunk_id, pool_idx, score) with ``relevance`` and ``rerank_rank``; ties keep the
    order of the pool."""
    out = scores.withColumn("relevance", sigmoid(F.col("score"), needs_sigmoid(F.col("score"))))
    return out.withColumn("rerank_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.round("relevance", PLACES).desc(), "pool_idx")))


def rerank(hits: DataFrame, scorer: Callable[[list[str], list[str]], list[float]] | Column, query: str = "query", text: str = "text") -> DataFrame:
    """``hits`` (with ``rank``, the query and the text) reordered by ``scorer``; scores belong to (query, chunk).

    ``scorer`` is an expression or a function from queries and texts to scores, run in Python workers.  A function that
    fails gives null scores for its batch; a query with a null score keeps its fused order and relevance."""
    pool = rerank_pool(hits)
    if isinstance(scorer, Column):
        scored = pool.withColumn("score", scorer)
    else:

        @F.pandas_udf("double")
        def of(queries: pd.Series, texts: pd.Series) -> pd.Series:
            try:
                return pd.Series([float(x) for x in scorer(queries.tolist(), texts.tolist())], index=queries.index)
            except Exception:  # noqa: BLE001  the search goes on without this stage
                return pd.Series([None] * len(queries), index=queries.index, dtype="float64")

        scored = pool.withColumn("score", of(query, text))
    failed = F.max(F.col("score").isNull()).over(W.partitionBy("query_id"))
    out = rerank_order(scored.withColumn("failed", failed))
    return out.withColumns({
        "relevance": F.when(F.col("failed"), relevance(F.col("rrf"))).otherwise(F.col("relevance")),
        "rank": F.when(F.col("failed"), F.col("rank")).otherwise(F.col("rerank_rank")),
    }).drop("failed", "pool_idx", "rerank_rank")


def limited(hits: DataFrame) -> DataFrame:
    """The first ``limit`` (a column) of each query, after a cap."""
    return renumbered(hits).filter("rank <= limit")


def above_min_score(hits: DataFrame) -> DataFrame:
    """Relevance of at least ``min_score`` (a column); applied after the limit, so nothing moves up."""
    return hits.filter(F.col("relevance") >= F.coalesce("min_score", F.lit(0.0)))


def merge_by_relevance(hits: DataFrame) -> DataFrame:
    """Hits of all knowledge bases (column ``kb``) in one order by query: relevance, then KB, then rank; the first
    ``limit``."""
    order = W.partitionBy("query_id").orderBy(F.round("relevance", PLACES).desc(), "kb", "rank")
    return hits.withColumn("merged_rank", F.row_number().over(order)).filter("merged_rank <= limit")
