"""The near-copy stage finds copies through SimHash fingerprints, before min-hashes name any."""

import pytest
from test_near_copies import corpus

from lakesearch.llm import near_copies, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_linked_fingerprints_are_joined_without_min_hashes(spark, monkeypatch):
    rows = [r for r in corpus() if r[0] is not None]
    monkeypatch.setattr(near_copies, "candidates", lambda units, *_: units.selectExpr("key AS u", "key AS v").limit(0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    text = dict(rows)
    sets = {i: near_copies.shingles(None if t is None else t.encode()) for i, t in rows}
    prints = {i: simhash.fingerprint(None if t is None else t.encode()) for i, t in rows}
    gone = set(text) - kept
    assert any(all(sets[i] != sets[j] for j in text if j < i) for i in gone)  # not only equal sets of shingles
    for i in gone:  # each has a similar document with a smaller id
        assert any(j < i and near_copies.jaccard(sets[i], sets[j]) >= 0.8 for j in text)
    for i in text:  # and no similar pair with one fingerprint is left
        assert not any(j in kept and i in kept and j < i and prints[i] == prints[j] and sets[i] == sets[j] for j in text)
