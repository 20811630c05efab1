"""A stored index by string ids takes little disk: postings have numbers, travel as blocks, and nothing is shuffled for what is gone."""

import os
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakesearch import plans, sources
from lakesearch.operators import chunking, extract, keyword, ranking
from lakesearch.plans import index as stored
from tests.test_keyword_blocks import corpus


def parts(spark, n=400):
    """Documents, chunks by ids of 42 characters, and vectors; chunks of documents that divide by 10 are blank."""
    name = F.concat(F.left(F.sha2(F.col("chunk_id").cast("string"), 256), F.lit(32)), F.lit("-000000000"))
    chunks = corpus(spark, n).withColumns({"doc_id": F.col("chunk_id"), "chunk_id": name})
    docs = chunks.select("doc_id", F.lit("s").alias("source_name"))
    return docs, chunks, ranking.read_embeddings(chunks.select("chunk_id", F.array(F.lit(1.0).cast("float")).alias("embedding")), 1)


def updated(spark, path, n=400):
    docs, chunks, vectors = parts(spark, n)
    of = lambda t, c: t.join(chunks.filter(c).select("chunk_id"), "chunk_id", "left_semi")
    first = plans.Index(docs.filter("doc_id < 300"), chunks.filter("doc_id < 300"), of(vectors, "doc_id < 300")).write(path)
    again = docs.filter("doc_id % 7 = 0 and doc_id < 300 or doc_id >= 300")  # some are replaced, some go, some come
    left = "doc_id >= 300 or doc_id % 7 > 0 or doc_id % 2 = 0"
    new = f"(doc_id % 7 = 0 or doc_id >= 300) and ({left})"
    return first, first.updated(again, docs.filter(new), chunks.filter(new), of(vectors, new)), chunks.filter(left)


def hits(index, chunks=None):
    spark = index.docs.sparkSession
    queries = spark.createDataFrame([(1, "w1 w2 w2 head"), (2, "w3"), (3, "none"), (4, "w5 w6 w7 w8 0"), (5, "head-w1 w9")], "query_id long, query string")
    found = keyword.best(queries, index.postings, index.lengths, index.stats, index.terms, k=7, block=2, part=50)
    return sorted((r.query_id, r.fts_rank, r.chunk_id, round(r.bm25, 9)) for r in ranking.ranked(found, "bm25", "fts_rank", 7).collect())


@pytest.mark.parametrize("sent", [stored.SENT, 0])
def test_segments_by_number_find_what_an_index_anew_finds(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(stored, "SENT", sent)
    monkeypatch.setattr(keyword, "DEALT", 500)  # several blocks for a part
    shared = tmp_path / "a shared folder"
    monkeypatch.setattr(sources, "shared_dir", lambda spark: f"file://{shared}")
    _, both, chunks = updated(spark, str(tmp_path / "i"))
    one, fresh = both.merged(), plans.Index(both.docs, chunks, both.vectors)
    assert hits(one) == hits(both) == hits(fresh) and {h[0] for h in hits(one)} == {1, 2, 4, 5}
    assert not [f for f in os.listdir(shared) if f.startswith("tokens-")]  # what was tokenised goes
    for i in (both, one):
        assert dict(i.postings.schema["chunk_no"].jsonValue())["type"] == "long"
        back = i.postings.join(i.lengths, "chunk_no").select("term", "chunk_id", "freq", "places")
        assert sorted(back.collect()) == sorted(fresh.postings.select(*back.columns).collect())
        assert i.lengths.select("chunk_no").distinct().count() == chunks.count()
        assert sorted(i.terms.groupBy("term").agg(F.sum("df").alias("n")).filter("n > 0").collect()) == sorted(keyword.term_counts(fresh.postings).collect())
        assert i.stats.first() == keyword.corpus_stats(fresh.lengths).first()


def exchanges(df):
    """Columns by which the plan deals rows, if it isn't a broadcast."""
    return re.findall(r"(?<!Broadcast)Exchange [a-zA-Z]+partitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_nothing_is_shuffled_for_what_is_gone(spark, tmp_path):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        _, both, _ = updated(spark, str(tmp_path / "i"))
        for table in (both.chunks, both.vectors, both.docs, both.lengths, both.postings, both.packs):
            assert exchanges(table) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_packs_travel_as_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword, "DEALT", 2000)
    tokens = keyword.tokens(corpus(spark, 3000)).repartition(2)
    dealt = []
    monkeypatch.setattr(keyword, "_in_buckets", lambda table, path, n: dealt.append(table))
    keyword.store(keyword.packs_of(tokens), str(tmp_path / "p"), 50_000, keyword.common_terms(tokens))
    assert sorted(keyword.unpacked(dealt[0].drop("h")).collect()) == sorted(keyword.postings_of(tokens).collect())
    assert re.search(r"MapInArrow .*\[part#\d+, block#\d+\]", dealt[0]._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("ids", [[5, -7, 1 << 62, -(1 << 62)], ["b", "a", "", "é"], [3, 4, 70_000, 5]])
def test_blocks_keep_what_they_hold(ids):
    packs = pa.table({"term": ["x", None], "n": pa.array([3, 1], pa.int32()), "ids": [ids[:3], ids[3:]], "freqs": pa.array([[1, 2, 1], [3]], pa.list_(pa.int32())), "places": [[[0], [1, 1 << 33], [70_000]], [[1, 2, 3]]]}).to_batches()[0]
    assert keyword._of_block(pa.scalar(keyword._as_block(packs))).to_pydict() == packs.to_pydict()


def test_files_of_one_block_are_cut_without_a_shuffle(spark):
    texts = [(str(i), "\n".join("" if k % 9 == 4 else f"line {k} " + "word " * (k % 7) for k in range(i * 20))) for i in range(8)] + [("x", " \n\n"), ("y", "a\r\nb\n\n")]
    blocks = extract.whole_file_block(spark.createDataFrame(texts, "doc_id string, text string"))
    for max_tokens, overlap in ((1 << 30, 0), (40, 10), (1, 0), (3, 50)):
        want, got = chunking.chunk_blocks(blocks, max_tokens, overlap), chunking.chunk_whole_files(blocks, max_tokens, overlap)
        assert got.schema.names == want.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
        assert exchanges(got) == [] != exchanges(want)
        assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # bounds are worked out once


def test_lengths_are_not_joined_to_matches(spark, tmp_path):
    first, _, _ = updated(spark, str(tmp_path / "i"), 301)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        queries = spark.createDataFrame([(1, "w1 w2 w2 head")], "query_id long, query string")
        found = keyword.best(queries, first.postings, first.lengths, first.stats, first.terms, k=7)
        cogroup = found._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[1]
        assert not [x for x in exchanges(found) if x.startswith("chunk_id")]
        assert "SortMergeJoin [chunk" not in cogroup
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
