"""Toxicity by compression distance.

Pairs of zstandard dictionaries are trained with the library's trainer, one of a pair on words of toxic texts and one on as many
of ordinary ones.  A text is cut into windows; each window is compressed with both dictionaries of a pair, and what the toxic
one saves is its evidence.  What savings of at least so many bytes are worth is calibrated on labelled texts that the
dictionaries haven't seen: how much more often windows of toxic texts reach each threshold than those of ordinary ones.  A
document's score is a calibrated function of the sum and the best of its windows' evidence.

A window is a word, written with its growing beginnings before it (``tr tra tras trash``), and with all its later
parts if it is long: a word that a dictionary knows, or whose beginning or part it knows, is then one long match, another one many short ones, and the difference is several bytes.  Runs of
more than ``RUN`` characters are several windows that overlap.  All dictionaries and windows share a preamble, so a window is never
stored uncompressed, and both dictionaries of a pair begin with the same ordinary words, so what both know costs the same.
The trainer keeps what is frequent in its samples; several trainings on parts of them keep what is frequent in some texts
only, for example in one language.  Words that texts of both classes hold train neither dictionary.

One pair's savings are noisy: which of two dictionaries happens to hold a piece of an ordinary word decides about bytes.  So
``PAIRS`` pairs are trained, each without one of ``FOLDS`` folds of the sample, and their savings are averaged; a word that the
first pair sees no saving in isn't shown to the others.  The folds give the savings to calibrate on.  Equal words have equal
savings, so a worker remembers those of words that it has met.
"""

from __future__ import annotations

import pickle
import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import logistic, ordered, sampled, sigmoid

#: Bounds of the training sample: documents of each class, characters of a document.
PER_CLASS, MAX_CHARS = 1500, 20_000
#: Lengths of a word's beginnings in bytes, and of the parts of one of more than ``LONG`` bytes; characters of the pieces of a longer run, and how many they share; marks that don't
#: belong to a word at its ends.
BEGINNINGS, PART, LONG, RUN, SHARED, EDGES = range(2, 10), 4, 11, 24, 8, ".,;:!?\"'()"
#: Pairs of dictionaries, and folds of the sample of which each pair misses one.
PAIRS, FOLDS = 6, 3
#: Bytes of a trained dictionary, trainings on parts of the samples, bytes of ordinary words before them, words in a training
#: sample, and the trainer's lengths of segments and of the strings that it counts.
SIZE, PARTS, BASE, TOGETHER, SEGMENT, STRING = 1500, 16, 100_000, 3, 40, 8
#: Least and most saving in bytes that is told apart, steps in a byte, and the saving at which the other pairs are asked.
LEAST, MOST, STEPS, ASKED = -8, 40, 2, 1
#: Shares of the ordinary texts of the sample that may be rejected, by the pairs that missed them (the average of all pairs is
#: steadier and rejects fewer), and how many times a share of them must be outweighed by that of the toxic ones found.
REFUSED, PRICE = (0.0, 0.0025, 0.005, 0.01, 0.02, 0.03), 2.5
#: Characters of text that are looked at together, and words whose evidence a worker remembers.
PIECE, REMEMBERED = 1 << 19, 600_000
PREAMBLE = bytes(range(232, 256))


def _words(text: str | None) -> list[str]:
    out = []
    for w in (text or "").lower().split():
        w = w.strip(EDGES) or w
        out += [w] if len(w) <= RUN else [w[i : i + RUN] for i in range(0, len(w) - SHARED, RUN - SHARED)]
    return out


def _pieces(text: str | None) -> Iterator[str]:
    """A text in pieces of about ``PIECE`` characters, cut at white space where there is any nearby."""
    text, at = text or "", 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and end < at + 2 * PIECE and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def _grown(word: str) -> bytes:
    w = word.encode()
    rest = [w[i : i + PART] for i in range(PART, len(w) - PART + 1)] if len(w) > LONG else []
    return b"".join(b" " + x for x in [*(w[:n] for n in BEGINNINGS if n < len(w)), *rest, w])


def window(word: str) -> bytes:
    """What is compressed of a word."""
    return PREAMBLE + _grown(word) + b" "


def _trained(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=STRING).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer
        return b"".join(samples)[-size:]


def train_dictionaries(texts: list[list[str]], toxic: np.ndarray, seed: int = 0) -> tuple[bytes, bytes] | None:
    """Dictionaries (toxic, ordinary) from equal numbers of words (``texts`` as lists of words) of both classes; ``None`` if one
    has no word of its own."""
    rng, known, found = random.Random(seed), (set(), set()), ([], [])
    for ws, y in zip(texts, toxic, strict=True):
        known[y].update(ws)
    run = lambda ws, n: [b"".join(map(_grown, ws[i : i + n])) + b" " for i in range(0, len(ws), n)]
    plain = []
    for ws, y in zip(texts, toxic, strict=True):
        found[y].extend(run([w for w in dict.fromkeys(ws) if w not in known[1 - y]], TOGETHER))
        plain += run(ws, 6) if y == 0 else []
    for x in (plain, *found):
        rng.shuffle(x)
    base, n = b"", 0
    while n < len(plain) and len(base) < BASE:
        base += plain[n]
        n += 1
    n_each = min(map(len, found))
    if not n_each:
        return None
    made = []
    for samples in (found[1][:n_each], found[0][:n_each]):
        parts = [_trained(samples[k::PARTS], SIZE) for k in range(PARTS)] if n_each >= 100 * PARTS else []
        made.append(b"".join([base, *parts, _trained(samples, SIZE), PREAMBLE]))
    return made[0], made[1]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    size = max(17, len(content).bit_length() + 1)  # all of the dictionary stays within reach
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(compression_level=3, window_log=size, hash_log=size - 2, chain_log=size - 1, search_log=4, min_match=6, target_length=128, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    data.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=how)


class _Pair:
    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)

    def saved(self, words: list[str]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each word."""
        if not words:
            return np.zeros(0)
        run = [window(w) for w in words]
        size = lambda c: np.fromiter(map(len, c.multi_compress_to_buffer(run, threads=1)), np.int64, len(run))
        return np.clip(size(self.ordinary) - size(self.toxic), LEAST, MOST).astype(np.float64)


def _mean_saving(pairs: list[_Pair], words: list[str]) -> np.ndarray:
    """The mean over all pairs, where the first one saves ``ASKED`` bytes or more, else its own."""
    out = pairs[0].saved(words)
    asked = np.flatnonzero(out >= ASKED)
    some = [words[i] for i in asked]
    out[asked] = (out[asked] + sum(p.saved(some) for p in pairs[1:])) / len(pairs)
    return out


def _step(saved: np.ndarray) -> np.ndarray:
    return np.round((saved - LEAST) * STEPS).astype(np.int64)


@lru_cache(2)
def _open(pairs: tuple[tuple[bytes, bytes], ...]) -> tuple[list[_Pair], dict[str, int]]:
    """The compressors of a model and the steps of the words met so far, kept by a worker from task to task."""
    return [_Pair(*p) for p in pairs], {}


@dataclass(frozen=True)
class ToxicityModel:
    """The pairs of dictionaries, the evidence of each step of the saving, and weights of the calibration."""

    pairs: tuple[tuple[bytes, bytes], ...]
    evidence: tuple[float, ...]
    weights: tuple[float, ...]

    def steps(self, words: list[str]) -> list[int]:
        """The step of each word's mean saving."""
        pairs, known = _open(self.pairs)
        new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(dict.fromkeys(words))
        known.update(zip(new, _step(_mean_saving(pairs, new)).tolist(), strict=True))
        return [known[w] for w in words]

    def score(self, texts) -> np.ndarray:
        if not self.pairs:
            return np.full(len(texts), sigmoid(self.weights[-1]))
        found, evidence = _nothing(len(texts)), np.array(self.evidence)
        for of, words in _together(texts):
            _add(found, of, evidence[self.steps(words)])
        return sigmoid(_features(found) @ np.array(self.weights[:-1]) + self.weights[-1])


def _together(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Words of all texts with the place of their text, a bounded number at a time."""
    of, words, size = [], [], 0
    for i, t in enumerate(texts):
        for piece in _pieces(t):
            found = _words(piece)
            of.append(np.full(len(found), i))
            words += found
            size += len(piece)
            if size >= PIECE:
                yield np.concatenate(of), words
                of, words, size = [], [], 0
    if words:
        yield np.concatenate(of), words


def _nothing(n: int) -> np.ndarray:
    """For each of ``n`` texts: windows, sum of evidence, sum of its squares, the best."""
    return np.zeros((4, n))


def _add(found: np.ndarray, of: np.ndarray, evidence: np.ndarray) -> None:
    n = found.shape[1]
    found[0] += np.bincount(of, minlength=n)
    found[1] += np.bincount(of, evidence, n)
    found[2] += np.bincount(of, evidence**2, n)
    np.maximum.at(found[3], of, evidence)


def _features(found: np.ndarray) -> np.ndarray:
    n, total, squares, best = found
    return np.column_stack([np.log((total + 0.05) / (n + 4)), np.log((squares + 0.05) / (n + 4)), best, np.sqrt(squares), np.log1p(n)])


def _evidence(steps: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each threshold the log of how many times as often windows of toxic texts reach it, smoothed, never falling and not
    below zero."""
    reach = [np.cumsum(np.bincount(steps[toxic == y], minlength=(MOST - LEAST) * STEPS + 1)[::-1])[::-1] for y in (0, 1)]
    n = [max(int(r[0]), 1) for r in reach]
    rate = [(r + 2 * m / sum(n)) / m for r, m in zip(reach, n, strict=True)]
    return np.maximum(np.maximum.accumulate(np.log(rate[1] / rate[0])), 0)


def fit(texts: list[str], toxic: np.ndarray, odds: float = 1.0) -> ToxicityModel:
    """Every pair of dictionaries misses one fold of each class; the savings of the pairs that missed a text calibrate the
    evidence and the score.  ``odds`` is how many times as often toxic texts were picked for the sample as ordinary ones.
    Without toxic or ordinary words of their own the score is a constant."""
    y = np.asarray(toxic, np.int64)
    constant = ToxicityModel((), (), (float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5))),))
    words, fold = [_words(t) for t in texts], np.zeros(len(y), np.int64)
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % FOLDS
    made = [train_dictionaries([w for w, f in zip(words, fold, strict=True) if f != k % FOLDS], y[fold != k % FOLDS], k) for k in range(PAIRS)]
    if None in made:
        return constant
    of = np.repeat(np.arange(len(y)), [len(w) for w in words])
    steps, flat = np.zeros(len(of), np.int64), [w for ws in words for w in ws]
    for f in range(FOLDS):
        mine = np.flatnonzero(fold[of] == f)
        each = list(dict.fromkeys(flat[i] for i in mine))
        known = dict(zip(each, _step(_mean_saving([_Pair(*made[k]) for k in range(PAIRS) if k % FOLDS == f], each)).tolist(), strict=True))
        steps[mine] = [known[flat[i]] for i in mine]
    evidence = _evidence(steps, y[of])
    found = _nothing(len(y))
    _add(found, of, evidence[steps])
    x = _features(found)
    w = logistic(x, y, ridge=0.3)
    # a text is rejected from 0.5: the cut is moved to where that pays on the sample
    said = x @ w[:-1]
    cuts = [(np.mean(said[y == 1] >= (cut := np.quantile(said[y == 0], 1 - q, method="higher"))) - PRICE * q, -cut) for q in REFUSED]
    w[-1] = max(w[-1] - np.log(odds), max(cuts)[1])
    return ToxicityModel(tuple(made), tuple(evidence.tolist()), tuple(w.tolist()))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> ToxicityModel:
    """A model from a bounded sample of the labelled documents.  A task fits it; the driver gets the model alone, since what its
    Python once took for the sample's words it would keep to the end of the session."""
    rows, odds = sampled(docs, labels, label, per_class, max_chars, text, doc_id)

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = ordered(rows)
        return pd.DataFrame({"model": [pickle.dumps(fit(rows["text"].tolist(), rows["y"].to_numpy(), odds))]})

    made = rows.groupBy().applyInPandas(fitted, "model binary").collect()  # bounded: 2 * per_class rows, one model
    return pickle.loads(made[0].model) if made else fit([], np.zeros(0), odds)


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text in column ``name``, an existing one replaced.  Null and empty
    texts have no window and get the calibrated score of a text without any.  Equal texts have equal scores; a very long one
    is read some words at a time; an empty table gives an empty result."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts))

    return docs.withColumn(name, of(text))
