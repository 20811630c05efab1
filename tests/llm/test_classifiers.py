"""Toxicity, line quality and the shared fitting helpers: held-out accuracy on made texts, and odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesearch.llm import quality_crf, toxicity, training

SYLLABLES = "ba ke li mo nu ra se ti vo zu an er is on ut".split()
INSULTS = ["grumblefoot", "snarkwit", "dolthead", "wretchling"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def labelled(kind, n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        y = i % 4 == 0
        lines = [prose(rng, rng.randrange(5, 40)).capitalize() + "." for _ in range(rng.randrange(1, 8))]
        if kind == "toxic" and y:
            for _ in range(rng.randrange(1, 4)):
                k = rng.randrange(len(lines))
                lines[k] = lines[k].replace(" ", f" {rng.choice(INSULTS)} ", 1)
        if kind == "quality" and y:
            k = rng.randrange(len(lines))
            lines[k:] = [" ".join(w + "!!" for w in x.upper().split()) for x in lines[k:]]
        out.append(("\n".join(lines), int(y) if kind == "toxic" else int(not y)))
    return out


@pytest.mark.parametrize(("kind", "module", "threshold"), [("toxic", toxicity, 0.5), ("quality", quality_crf, 0.3)])
def test_held_out_accuracy(kind, module, threshold):
    train, held = labelled(kind, 400, 1), labelled(kind, 200, 2)
    model = module.fit([t for t, _ in train], np.array([y for _, y in train]))
    predicted = model.score([t for t, _ in held]) >= threshold
    assert np.mean(predicted == np.array([y for _, y in held])) > 0.95


@pytest.mark.parametrize("module", [toxicity, quality_crf])
def test_one_class_and_odd_texts(module):
    for texts, y in (([], []), (["a b"], [1]), (["a b", "c d"], [0, 0])):
        model = module.fit(texts, np.array(y, np.int64))
        got = model.score([None, "", " \n", "one", "x" * 20_000, "word " * 30_000])
        assert got.shape == (6,) and np.all((got >= 0) & (got <= 1))


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    scores, transition = [rng.normal(size=n) for n in (4, 1, 0, 3)], rng.normal(size=(2, 2))
    got, pairs, total = quality_crf._marginals(scores, transition)
    want_total, want_pairs = 0.0, np.zeros((2, 2))
    for s, p in zip(scores, got):
        n = len(s)
        weight, hit, pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(1 << n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(s[k] for k in range(n) if y[k]) + sum(transition[a, b] for a, b in zip(y, y[1:])))
            weight += w
            hit += w * np.array(y)
            for a, b in zip(y, y[1:]):
                pair[a, b] += w
        assert np.allclose(p, hit / weight)
        want_total += np.log(weight) if n else 0
        want_pairs += pair / weight
    assert np.isclose(total, want_total) and np.allclose(pairs, want_pairs)


def test_lines_get_their_neighbours_features():
    features, lengths = quality_crf.line_features("Good line here.\n\nLOUD!! LOUD!!\n")
    n = quality_crf._OWN
    assert features.shape == (2, 3 * n) and lengths.tolist() == [15, 13]
    assert np.array_equal(features[0, 2 * n :], features[1, :n]) and not features[0, n : 2 * n].any()


def test_toxic_dictionary_saves_bytes_on_toxic_windows():
    train = labelled("toxic", 400, 1)
    model = toxicity.fit([t for t, _ in train], np.array([y for _, y in train]))
    rng = random.Random(9)
    pairs = [toxicity._Pair(*p) for p in model.pairs]
    saved = lambda words: np.mean([p.saved(words) for p in pairs], axis=0)
    plain, toxic = saved(toxicity._words(" ".join(prose(rng, 5) for _ in range(200)))), saved(list(INSULTS))
    assert toxic.mean() > plain.mean() + 5 and abs(plain.mean()) < 2


def test_training_sample_is_bounded_and_stable(spark):
    docs = spark.createDataFrame([(i, "t" * (1 + i % 50), i % 2) for i in range(300)], "doc_id long, text string, y int")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    labels = labels.union(spark.createDataFrame([(7, None), (None, 1), (8, 5), (4, 1), (9999, 1)], "doc_id long, quality int"))
    a = training.sample(docs, labels, "quality", 20, 30)
    assert a.equals(training.sample(docs, labels.orderBy(F.desc("doc_id")), "quality", 20, 30))
    assert a["text"].str.len().max() <= 30 and a["y"].value_counts().max() <= 20 and (a["id"] % 2 == a["y"]).all()


def test_best_cut():
    x, y = np.array([0.1, 0.2, 0.3, 0.8, 0.9, 0.9]), np.array([0, 0, 0, 1, 1, 1])
    assert 0.3 < training.best_cut(x, y) < 0.8


@pytest.mark.parametrize(("module", "score"), [(toxicity, "toxicity"), (quality_crf, "quality_score")])
def test_columns_on_spark(spark, module, score):
    rows = [(1, "Good text here.", 0.0), (1, "Good text here.", 0.0), (None, None, 0.0), (3, "", 0.0)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {score} double")
    kind = "toxic" if module is toxicity else "quality"
    train = labelled(kind, 80, 4)
    model = module.fit([t for t, _ in train], np.array([y for _, y in train]))
    add = toxicity.with_toxicity if module is toxicity else quality_crf.with_quality
    got = add(docs, model).collect()
    assert len(got) == 4 and all(0 <= r[score] <= 1 for r in got)
    assert len({r[score] for r in got if r.doc_id == 1}) == 1
    assert add(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([], f"doc_id long, {kind} int")
    assert add(docs, module.train(docs, labels)).count() == 4
