"""Quality rules under weak supervision.

Every rule looks at one measure of a text and votes good, bad or, far off, strongly bad, or abstains where the measure says
little.  Expectation-maximisation over the counts of vote patterns of the whole corpus estimates how often good and bad
documents get each of these votes, and the share of good ones; the posterior probability of "good" replaces a filter that
all rules must pass: a bad vote that good documents often get is outvoted, one that they hardly ever get decides, and a
document to which many rules have nothing to say is judged by that, too.  Measures that rise and fall together are one rule,
so that the same fault isn't counted twice.  The counts are one row for each pattern, at most 4 to the number of rules,
whatever the corpus size; so the estimation itself runs on the driver.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Texts, batches, covered, window_hashes

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
#: Words in a stretch whose distinct words are counted, so that the figure doesn't depend on a text's length.
STRETCH = 100
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_COUNTS = [*_BASE, "n_lines", "n_distinct", "n_plain", "n_upper", "n_shouts", "n_echoes"]
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_ODD = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])
_IS_END = np.zeros(256, bool)
_IS_END[list(b".,;:!?")] = True


def measures(texts: list) -> dict[str, np.ndarray]:
    """Counts for each text (bytes or ``None``): those of ``measure``."""
    out = {k: np.zeros(len(texts), np.int64) for k in _COUNTS}
    for at, run in batches(texts):
        t = Texts(run)
        n = len(run)
        a = np.frombuffer(t.data + b"\n", np.uint8)
        lead = np.concatenate(([0], np.cumsum((a & 0xC0) != 0x80)))
        symbols = np.concatenate(([0], np.cumsum(_IS_SYMBOL[a])))
        odd = np.concatenate(([0], np.cumsum(_IS_ODD[a])))
        lengths = lead[t.ends] - lead[t.starts]
        others = odd[t.ends] - odd[t.starts]
        plain = (others == 0) | ((others == 1) & _IS_END[a[t.ends - 1]] & (lengths > 1))
        part = {"n_words": np.diff(t.first), "word_chars": np.bincount(t.text_of, lengths, n), "n_symbols": symbols[t.offsets[1:] - 1] - symbols[t.offsets[:-1]], "n_plain": np.bincount(t.text_of, plain, n)}
        inside = np.flatnonzero(t.whole(REPEAT_WINDOW))
        key = window_hashes(t.hashes, REPEAT_WINDOW)[inside] + t.text_of[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
        twice = np.zeros(len(order), bool)
        twice[:-1] |= same
        twice[1:] |= same
        part["n_repeat_words"] = np.bincount(t.text_of, covered(inside[order[twice]], REPEAT_WINDOW, len(t.starts)), n)
        for i, text in enumerate(run):
            words = text.split()
            lines = [line for line in text.split(b"\n") if line.split()]
            out["n_lines"][at + i] = len(lines)
            out["n_dup_lines"][at + i] = len(lines) - len(set(lines))
            out["n_distinct"][at + i] = sum(len(set(words[k : k + STRETCH])) for k in range(0, len(words), STRETCH))
            out["n_upper"][at + i] = sum(map(bytes.isupper, words))
            out["n_shouts"][at + i] = text.count(b"!")
            out["n_echoes"][at + i] = sum(map(operator.eq, words, words[1:]))
        for k, v in part.items():
            out[k][at : at + n] = v
    return out


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with long columns added (existing ones replaced): ``n_words``, ``word_chars`` (code points in words),
    ``n_symbols`` (characters of ``SYMBOLS``), ``n_dup_lines`` (lines with a word, equal to an earlier line),
    ``n_repeat_words`` (words in windows of eight that occur twice or more in the text), ``n_lines`` (lines with a word),
    ``n_distinct`` (distinct words in stretches of ``STRETCH`` words, added up), ``n_plain`` (words of letters alone, with at
    most one mark at the end; characters beyond ASCII are taken for letters), ``n_upper`` (words in capitals), ``n_shouts``
    (exclamation marks), ``n_echoes`` (words equal to the one before).

    Null and empty texts have zero everywhere; texts are read whole."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in _COUNTS])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in _COUNTS)])

    def each(tables):
        for b in tables:
            found = measures(b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(found[c]) for c in _COUNTS)], names=[*b.schema.names, *_COUNTS])

    return docs.mapInArrow(each, schema)


#: Votes of a rule.
WORST, BAD, ABSTAIN, GOOD = range(4)


def _graded(fault: Column, good: float, bad: float, worst: float) -> Column:
    """The vote on a measure that is higher for worse texts: good up to ``good``, bad from ``bad`` on, strongly from ``worst``."""
    return F.when(fault >= worst, WORST).when(fault >= bad, BAD).when(fault <= good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """The rules over the columns of ``measure``, by name.  The limits are fixed values; what a vote is worth isn't."""
    n = F.greatest("n_words", F.lit(1))
    return {
        "length": _graded(100 / n, 1.0, 2.0, 5.0),
        "word_length": _graded(F.abs(F.col("word_chars") / n - 5), 1.5, 3.0, 6.0),
        "vocabulary": _graded(1 - F.col("n_distinct") / n, 0.4, 0.6, 0.8),
        "symbols": _graded(F.col("n_symbols") / n, 0.005, 0.05, 0.3),
        "plain_words": _graded(1 - F.col("n_plain") / n, 0.1, 0.3, 0.6),
        "dup_lines": _graded(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), 0.0, 0.1, 0.5),
        "repeats": _graded(F.col("n_repeat_words") / n, 0.01, 0.1, 0.3),
        "capitals": _graded(F.col("n_upper") / n, 0.03, 0.06, 0.3),
        "shouting": _graded(F.col("n_shouts") / n, 0.01, 0.03, 0.2),
        "echoes": _graded(F.col("n_echoes") / n, 0.02, 0.04, 0.25),
    }


#: First guess, in the order of the votes: their chances on good and on bad documents, and the share of good ones.  It starts
#: the estimation, says which of the two classes is the good one, and weighs as much as ``WEIGHT`` documents of each class.
GUESS = np.array([[0.001, 0.06, 0.10, 0.839], [0.20, 0.16, 0.10, 0.54]])
SHARE, WEIGHT = 0.85, 4.0


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents and, by rule, the chances of each vote on good and on bad documents."""

    prior: float
    votes: dict[str, tuple[tuple[float, ...], tuple[float, ...]]]

    @property
    def accuracy(self) -> dict[str, float]:
        """How often a rule is right where it votes."""
        out = {}
        for name, (good, bad) in self.votes.items():
            right = self.prior * good[GOOD] + (1 - self.prior) * (bad[BAD] + bad[WORST])
            wrong = self.prior * (good[BAD] + good[WORST]) + (1 - self.prior) * bad[GOOD]
            out[name] = right / (right + wrong)
        return out

    def posterior(self, votes: dict[str, Column]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, (good, bad) in self.votes.items():
            each = [math.log(a / b) for a, b in zip(good, bad, strict=True)]
            odds = odds + F.when(votes[name] == WORST, each[WORST]).when(votes[name] == BAD, each[BAD]).when(votes[name] == GOOD, each[GOOD]).otherwise(each[ABSTAIN])
        return 1 / (1 + F.exp(-odds))


def estimate(names: list[str], patterns: np.ndarray, counts: np.ndarray, rounds: int = 1000) -> LabelModel:
    """Expectation-maximisation on distinct vote patterns (rows of votes) with their counts: rules vote independently given
    the true class, each with chances of its own for every vote, abstention among them.  No documents give the first guess."""
    patterns = np.asarray(patterns, np.int64).reshape(-1, len(names))
    counts = np.asarray(counts, np.float64)
    cast = np.eye(4)[patterns]
    table, prior = np.repeat(GUESS[:, None, :], len(names), axis=1), SHARE
    for _ in range(rounds if counts.sum() else 0):
        odds = math.log(prior / (1 - prior)) + np.einsum("pjv,jv->p", cast, np.log(table[0] / table[1]))
        good = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        share = [counts * good, counts * (1 - good)]
        now = np.stack([(np.einsum("p,pjv->jv", s, cast) + WEIGHT * g) / (s.sum() + WEIGHT) for s, g in zip(share, GUESS, strict=True)])
        prior = float((share[0].sum() + WEIGHT * SHARE) / (counts.sum() + WEIGHT))
        moved, table = np.abs(now - table).max(), now
        if moved < 1e-10:
            break
    return LabelModel(prior, {n: (tuple(table[0, j].tolist()), tuple(table[1, j].tolist())) for j, n in enumerate(names)})


def label_model(measured: DataFrame) -> LabelModel:
    """The model for the votes on all rows of ``measured``."""
    votes = rules()
    found = measured.select(*(v.cast("int").alias(k) for k, v in votes.items())).groupBy(*votes).count().orderBy(*votes).collect()
    return estimate(list(votes), [tuple(r[:-1]) for r in found], [r[-1] for r in found])


def judged(measured: DataFrame, model: LabelModel, least: float = 0.5) -> DataFrame:
    """``measured`` with ``base_failed`` (fewer than 20 words, or over 30 % of them in repeated windows), ``quality`` (the
    posterior) and ``kept`` (not failed and posterior at least ``least``), existing columns of these names replaced."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.withColumns({"base_failed": failed, "quality": model.posterior(rules())}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
