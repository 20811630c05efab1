"""Toxic parts count wherever they stand in a word or in a run without spaces."""

import math
import random

import numpy as np

from lakesearch.llm import toxicity


def model(space, tail=lambda rng: "qwyxzj"):
    rng = random.Random(5)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(5, 8)))
    texts, y = [], []
    for i in range(900):
        words = [word() for _ in range(40)]
        if i % 2:
            for k in rng.sample(range(40), 8):
                words[k] = word()[:10] + tail(rng)
        texts.append(space.join(words))
        y.append(i % 2)
    return toxicity.fit(texts, np.array(y)), word


def test_late_part_of_a_compound_is_scored():
    m, word = model(" ")
    clean = [word() for _ in range(40)]
    toxic = [w[:10] + "qwyxzj" if i % 5 == 0 else w for i, w in enumerate(clean)]
    a, b = m.score([" ".join(clean), " ".join(toxic)])
    assert a < 0.5 < b


def test_text_without_spaces_is_scored_to_its_end():
    m, word = model("")
    words = [word() for _ in range(40)]
    clean, toxic = "".join(words), "".join(w[:10] + "qwyxzj" if i > 20 else w for i, w in enumerate(words))
    a, b = m.score([clean, toxic])
    assert a < b and b > 0.5
    assert len(toxicity._words("水" * 5000)) > 300


def test_every_word_is_a_window_and_whole(monkeypatch):
    for n in (0, 1, 2, 7, 103):
        words = [f"w{i}" + "é" * (i % 20) for i in range(n)]
        assert toxicity._words(" ".join(f"({w})," for w in words)) == words
        assert all(toxicity.window(w).endswith(b" " + w.encode() + b" ") for w in words)
    assert toxicity._words(None) == toxicity._words("") == toxicity._words(" \n") == []
    assert toxicity._words("... !") == ["...", "!"]
    monkeypatch.setattr(toxicity, "PIECE", 10)
    text = "one two three fourteen fifteen " * 3 + "x" * 45
    pieces = list(toxicity._pieces(text))
    assert "".join(pieces) == text and len(pieces) > 5
    assert [w for p in toxicity._pieces(text[:90]) for w in toxicity._words(p)] == toxicity._words(text[:90])


def test_scores_are_those_of_single_windows(monkeypatch):
    """Plain Python, one window and one dictionary at a time, against the batches and what a worker remembers."""
    m, word = model(" ")
    monkeypatch.setattr(toxicity, "PIECE", 50)
    monkeypatch.setattr(toxicity, "REMEMBERED", 20)
    texts = [" ".join(word() for _ in range(n)) for n in (3, 0, 40, 200)] + [None, "one", "x" * 3000]
    both = [(toxicity._compressor(t), toxicity._compressor(o)) for t, o in m.pairs]
    assert len(both) == toxicity.PAIRS
    for _ in range(2):
        for t, got in zip(texts, m.score(texts), strict=True):
            seen = []
            for w in [w for p in toxicity._pieces(t) for w in toxicity._words(p)]:
                saved = [min(max(len(o.compress(toxicity.window(w))) - len(a.compress(toxicity.window(w))), toxicity.LEAST), toxicity.MOST) for a, o in both]
                mean = sum(saved) / len(saved) if saved[0] >= toxicity.ASKED else saved[0]
                seen.append(m.evidence[int(np.round((mean - toxicity.LEAST) * toxicity.STEPS))])
            n, total, squares, best = len(seen), sum(seen), sum(x * x for x in seen), max([0, *seen])
            x = [math.log((total + 0.05) / (n + 4)), math.log((squares + 0.05) / (n + 4)), best, math.sqrt(squares), math.log1p(n)]
            assert abs(got - 1 / (1 + math.exp(-sum(p * q for p, q in zip(x, m.weights)) - m.weights[-1]))) < 1e-9


def test_the_compressor_tells_unseen_texts_apart():
    """Toxic text of words that no training text holds, but that begin like those that do, saves bytes as well: the dictionaries
    are no list of words."""
    m, word = model(" ", tail=lambda rng: "qwyxzj" + "".join(rng.choice("aeiou") for _ in range(4)))
    clean = [word() for _ in range(60)]
    toxic = [f"{w[:10]}qwyxzj{'bcdfg'[i % 5]}" if i % 4 == 0 else w for i, w in enumerate(clean)]
    assert not any(w.encode() in t for w in toxic[::4] for t, _ in m.pairs)
    a, b = m.score([" ".join(clean), " ".join(toxic)])
    assert a < 0.5 < b


def test_evidence_rises_with_the_saving():
    rng = np.random.default_rng(0)
    saved = np.concatenate([rng.integers(0, 20, 900), rng.integers(0, 96, 100)])
    found = toxicity._evidence(saved, np.concatenate([rng.integers(0, 2, 900), np.ones(100, int)]))
    assert (np.diff(found) >= 0).all() and found[0] == 0 < found[-1]


def test_held_out_texts_of_the_tables():
    """Texts outside the sample, for two draws of the ordinary ones, on the given tables."""
    import zlib

    import pandas as pd

    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    held = docs.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)
    train, test = docs[~held & docs.text.str.len().between(1, toxicity.MAX_CHARS)], docs[held]
    bad, good = train[train.toxic == 1], train[train.toxic == 0]
    for seed in (1, 2):
        both = pd.concat([bad, good.sample(1500, random_state=seed)])
        m = toxicity.fit(both.text.tolist(), both.toxic.to_numpy(), len(good) / 1500)
        score, y = m.score(test.text.tolist()), test.toxic.to_numpy()
        rank = pd.Series(score).rank().to_numpy()
        area = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
        assert area > 0.92 and (score[y == 1] >= 0.5).mean() > 0.7 and (score[y == 0] >= 0.5).mean() < 0.02
