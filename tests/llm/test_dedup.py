"""Substring dedup and SimHash against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lakesearch.llm import simhash, substring_dedup
from lakesearch.llm.words import Texts, word_hashes

DOCS = "doc_id long, text string"


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma délta eps ζeta η 水 x yy".split()) + str(rng.randrange(60))
    shared = [" ".join(word() for _ in range(rng.randrange(13, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(3)]
        for _ in range(rng.randrange(0, 3)):
            parts.insert(rng.randrange(len(parts)), rng.choice(shared))
        rows.append((i * 3 % (n * 3), "\n".join(parts)))
    rows += [(900 + k, rows[5][1]) for k in range(10)]  # copies
    rows += [(990, None), (991, ""), (992, " \t\n"), (993, "w" * 5000), (994, " ".join(["same"] * 40)), (995, " ".join(["same"] * 41))]
    rows += [(7, rows[5][1]), (7, rows[5][1]), (None, rows[5][1]), (None, shared[0])]  # repeated rows and null ids
    rng.shuffle(rows)
    return rows


def brute_force(rows, window=13):
    big = 1 << 62
    ids = [big if i is None else i for i, _ in rows]
    first = {}
    split = [(t or "").encode().split() for _, t in rows]
    for i, w in zip(ids, split):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, big), i)
    out = []
    for (i, t), own, w in zip(rows, ids, split):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < own:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [13, 5, 2])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(substring_dedup, "BLOCK", 2000)  # many blocks and buckets
    monkeypatch.setattr(substring_dedup, "BUCKET", 6000)
    rows = corpus()
    got = substring_dedup.drop_repeats(spark.createDataFrame(rows, DOCS), window).collect()
    found = sorted(((r.doc_id, r.n_words, r.n_removed, " ".join((r.text or "").split())) for r in got), key=repr)
    assert found == brute_force(rows, window)
    assert {r.text for r in got if r.doc_id == 990} == {None}
    assert all(sum(s.end - s.begin for s in r.removed_spans) == r.n_removed for r in got)


def test_substring_dedup_keeps_other_columns_and_unchanged_texts(spark):
    rows = [(1, "a  b\nc", 5, "x"), (2, "a  b\nc", 6, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, block string")
    got = {r.doc_id: r for r in substring_dedup.drop_repeats(docs).collect()}
    assert got[1].text == "a  b\nc" and got[1].n_words == 3 and got[2].block == "y"
    assert substring_dedup.drop_repeats(docs.limit(0)).count() == 0


def test_covers_hold_every_difference():
    for v, d in substring_dedup.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))
    assert substring_dedup.cover(13) == (7, (0, 1, 3))


def test_word_hashes_in_pieces(monkeypatch):
    from lakesearch.llm import words

    text = ("ab cé\x0b  " * 50 + "z" * 300 + " end").encode()
    whole = word_hashes(text)
    monkeypatch.setattr(words, "_PIECE", 64)
    for a, b in zip(whole, word_hashes(text)):
        assert np.array_equal(a, b)
    assert [text[s:e] for s, e in zip(*whole[:2])] == text.split()
    assert Texts([]).hashes.size == 0 and Texts([b"", b"a"]).first.tolist() == [0, 0, 1]


def slow_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64(b" ".join(w[i : i + 4]), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for t in [None, "", " \n", "One", "one TWO three", "É a b c d e", "a b c d e f g " * 50]:
        assert simhash.fingerprint(None if t is None else t.encode()) == slow_fingerprint(t)


def unions(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("block", [1 << 18, 50])
def test_links_match_brute_force(spark, block):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
    near = np.repeat(base[:6], 40)  # dense groups
    for _ in range(5):
        near = near ^ np.where(rng.random(len(near)) < 0.5, np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64), np.uint64(0))
    fps = np.unique(np.concatenate([base, near, [np.uint64(0), np.uint64(3), ~np.uint64(0)]]))
    pairs = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    want = unions(len(fps), pairs.tolist())
    place = {int(f): i for i, f in enumerate(fps.view(np.int64).tolist())}
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    got = [(place[r.u], place[r.v]) for r in simhash.linked(df, 4, block).collect()]
    assert unions(len(fps), got) == want


def test_few_pairs_of_blocks_survive(spark):
    """A thousand blocks of spread-out fingerprints: their roots rule out most pairs, and no link is lost."""
    rng = np.random.default_rng(7)
    fps = np.sort(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    near = fps[::50] ^ (np.uint64(1) << rng.integers(0, 64, len(fps[::50])).astype(np.uint64)) ^ np.uint64(1 << 40)
    fps = np.unique(np.concatenate([fps, near]))
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    blocks = np.array_split(fps[np.argsort(rank)], 1024)
    roots = [(i, *(int(x) for x in np.array([~(np.bitwise_and.reduce(b) ^ np.bitwise_or.reduce(b)), np.bitwise_and.reduce(b)], np.uint64).view(np.int64))) for i, b in enumerate(blocks)]
    kept = {tuple(r) for r in simhash.block_pairs(spark.createDataFrame(roots, "block int, mask long, pattern long"), 4).collect()}
    assert len(kept) < 0.2 * 1024 * 1025 / 2 and all((i, i) in kept for i in range(1024))
    of = {int(f): i for i, b in enumerate(blocks) for f in b}
    pairs = [(int(a), int(b)) for a in near for b in fps if a != b and (int(a) ^ int(b)).bit_count() <= 4 and ((int(a) ^ int(b)) >> 32).bit_count() <= 2]
    assert pairs and all(tuple(sorted((of[a], of[b]))) in kept for a, b in pairs)
    # the whole join, against all pairs
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    place = {int(f): i for i, f in enumerate(fps.view(np.int64).tolist())}
    got = unions(len(fps), [(place[r.u], place[r.v]) for r in simhash.linked(df, 4, 700).collect()])
    want = unions(len(fps), [(i, j) for i in range(len(fps)) for j in (np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)).tolist() if j != i])
    assert got == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 2000) for i in range(50)] + [(5, 5)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(1, 201)} == {0} and {got[1000 + i] for i in range(1, 50)} == {1000} and got[2000] == 1000


def test_near_groups_matches_brute_force(spark):
    rng = random.Random(5)
    words = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(n)]
    rows, base = [], [words(400) for _ in range(6)]
    for i in range(60):
        w = list(rng.choice(base))
        if i % 3:
            w[rng.randrange(len(w))] = "changed"
        rows.append((1000 - i, " ".join(w)))
    rows += [(1, None), (2, ""), (3, "A b"), (4, "a B"), (3, "A b"), (None, "a b"), (None, "unlike all"), (5, "x " * 3000)]
    got = simhash.near_groups(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", fp int")).collect()
    fps = np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    root = unions(len(rows), np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4).tolist())
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, int(f.astype(np.int64)), least.get(r)) for (i, _), f, r in zip(rows, fps, root)), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(i for (i, _), r in zip(rows, root) if i is not None and least[r] == i)
    empty = simhash.near_groups(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and simhash.as_hex(F.lit(10)) is not None
