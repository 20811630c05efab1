"""The pipeline's near-copy stage against all pairs by Jaccard similarity."""

import random

import pytest
from test_dedup import unions

from lakesearch.llm import near_copies

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus():
    rng = random.Random(4)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(30, 200))]
        for k in range(8):
            words = list(base)
            for _ in range(k if k < 5 else 2 * k):
                words[rng.randrange(len(words))] = f"x{rng.randrange(900)}"
            rows.append(" ".join(words))
    rows += [rows[3].upper(), rows[3].replace(" ", "\n"), None, "", " ", "one two", "one  two", "one two three"]
    return [(i * 7 % 997, t) for i, t in enumerate(rows)] + [(None, rows[0]), (None, None)]


def test_stage_is_brute_force_jaccard(spark):
    rows = corpus()
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    sets = [near_copies.shingles(None if t is None else t.encode()) for _, t in known]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if near_copies.jaccard(sets[i], sets[j]) >= 0.8]
    assert len(near) > 50
    root = unions(len(known), near)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(known[r][0] for r in set(root))
    assert sum(r.doc_id is None for r in got) == 2
