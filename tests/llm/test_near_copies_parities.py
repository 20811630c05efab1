"""Parities keep the pairs of a large group of texts that are not quite near copies from being listed."""

import random

import numpy as np
import pytest
from test_dedup import unions

from lakesearch.llm import near_copies


def test_few_pairs_below_the_similarity_are_listed(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(700)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(700), 9 if i % 2 else 14):
            words[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = [near_copies.shingles(t.encode()) for _, t in rows]
    alike = {(i, j): near_copies.jaccard(sets[i], sets[j]) for i in range(60) for j in range(i)}
    near = {p for p, s in alike.items() if s >= 0.8}
    assert near and sum(0.65 < s < 0.77 for s in alike.values()) > 500
    listed = []
    inner = near_copies.candidates

    def counted(units, similarity, every):
        found = inner(units, similarity, every)
        listed.append(found.count())
        return found

    monkeypatch.setattr(near_copies, "candidates", counted)
    got = near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(unions(60, near)))
    assert sum(listed) < len(near) + 300  # of 1,770 pairs; all of them share buckets


def test_a_pair_is_listed_in_its_first_bucket():
    bands = np.array([[1, 2, 3], [1, 2, 4], [5, 2, 3]])
    rows = sorted((b, i) for i in range(3) for b in bands[i])
    bucket, at = (np.array(x) for x in zip(*rows, strict=True))
    same = [bytes(near_copies.PARITY // 8)] * len(rows)
    for every, want in (True, [(0, 1), (0, 2), (1, 2)]), (False, [(0, 1), (1, 2)]):
        u, v = near_copies.pairs(bucket, at, at, np.full(len(rows), 9), same, bands[at], 0.8, every)
        assert sorted(zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist(), strict=True)) == want


@pytest.mark.parametrize("most", [20, 200, 2000])
def test_parities_of_all_widths_are_compared_exactly(most):
    rng = np.random.default_rng(3)
    sets = [set(rng.integers(0, 1 << 40, size=n).tolist()) for n in (3, 100, 400, 400, 3000, 9000)]
    sets += [s | set(rng.integers(0, 1 << 40, size=len(s) // 9).tolist()) for s in sets]

    def parity(s, bits):
        return np.bincount(np.array(list(s)) % bits, minlength=bits) & 1

    widths = [max(near_copies.PARITY, 1 << (2 * len(s) - 1).bit_length()) for s in sets]
    made = near_copies.Parities([np.packbits(parity(s, w).astype(bool)).tobytes() for s, w in zip(sets, widths, strict=True)])
    a, b = (x.ravel() for x in np.meshgrid(range(len(sets)), range(len(sets))))
    for i, j, ok in zip(a, b, made.near(a, b, np.full(len(a), most)), strict=True):
        w = min(widths[i], widths[j])
        apart, least = (int((parity(sets[i], x) ^ parity(sets[j], x)).sum()) for x in (w, near_copies.PARITY))
        assert ok == (apart <= most) and least <= apart <= len(sets[i] ^ sets[j])
