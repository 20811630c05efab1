"""Substring dedup with difference-cover anchors.

Two copies of a passage of ``window`` words start at unrelated positions of their documents.  Take a period ``v`` and a
difference cover ``D`` of it (every residue is a difference of two members of ``D``): for any two positions there is a
shift below ``v`` after which both lie in ``D`` modulo ``v``.  So if every document hashes its runs of ``window - v + 1``
words only at positions in ``D`` modulo ``v``, any two equal windows contain one equal anchor, and anchors that no other
document has rule out all windows without a shared one.  The windows left are compared as wholes, which extends the
anchors to full matches.

How it runs: documents are dealt into blocks of about ``BLOCK`` bytes by a hash (the one shuffle of text; the three steps
that need it read the same exchange).  A block asks about its distinct anchors, then about its distinct candidate
windows: one row for each bucket of the hash space, holding the sorted keys of that bucket.  A bucket answers with one
bit a key.  A key that a third of all documents hold is sent once by each block, so no key makes a hot task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import fresh
from .words import Texts, batches, covered, window_hashes

#: Period and a difference cover of it; fixed values (perfect difference sets).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Bytes of text in a block, and bytes of the corpus for each bucket of keys.
BLOCK, BUCKET = 2 << 20, 16 << 20
_NO_ID = np.iinfo(np.int64).max


def cover(window: int) -> tuple[int, tuple[int, ...]]:
    """The period and cover for a window: the longest period that leaves anchors of at least half the window."""
    return max((v, d) for v, d in COVERS.items() if v <= (window + 1) // 2)


def _ask(bucket: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by bucket, then key, and the places in it where a new key begins."""
    order = np.lexsort((key, bucket))
    b, k = bucket[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
    return order, new


class Block:
    """One block's documents with their anchors and, once told which anchors are shared, their candidate windows.

    What is sent and answered is in the order of the sorted distinct keys, which doesn't depend on the order of rows.
    """

    def __init__(self, ids: np.ndarray, texts: list, window: int, buckets: int):
        self.window, self.buckets, self.ids = window, np.uint64(buckets), ids
        self.period, self.cover = cover(window)
        self.width = window - self.period + 1
        self.parts = [(at, Texts(run)) for at, run in batches(texts)]
        self.anchors = [self._anchors(t) for _, t in self.parts]

    def _split(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * self.buckets) >> np.uint64(32)

    def _anchors(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        inside = t.whole(self.width)
        at = np.flatnonzero(inside & np.isin(t.place[: len(inside)] % self.period, self.cover))
        return at, window_hashes(t.hashes, self.width, 1)[at]

    def _ids_of(self, at: int, t: Texts, places: np.ndarray) -> np.ndarray:
        return self.ids[at + t.text_of[places]]

    def _grouped(self, bucket: np.ndarray, key: np.ndarray, ids: np.ndarray):
        order, new = _ask(bucket, key)
        first = np.flatnonzero(new)
        low = np.minimum.reduceat(ids[order], first) if len(first) else ids[:0]
        high = np.maximum.reduceat(ids[order], first) if len(first) else ids[:0]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        return bucket[order][first], key[order][first], low, high, group

    def anchor_keys(self):
        h = np.concatenate([a[1] for a in self.anchors]) if self.anchors else np.zeros(0, np.uint64)
        ids = np.concatenate([self._ids_of(p[0], p[1], a[0]) for p, a in zip(self.parts, self.anchors, strict=True)]) if self.anchors else np.zeros(0, np.int64)
        return self._grouped(self._split(h), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), ids)

    def windows(self, answers: dict[int, bytes]):
        """Keys of the windows that hold a shared anchor; also their places in each part."""
        bucket, _, low, high, group = self.anchor_keys()
        shared = ((low != high) | _bits(bucket, answers))[group]
        places, keys, ids, buckets, at = [], [], [], [], 0
        for (first, t), (anchors, _) in zip(self.parts, self.anchors, strict=True):
            hit = np.zeros(len(t.starts) + 1, np.int64)
            hit[anchors + 1] = shared[at : at + len(anchors)]
            at += len(anchors)
            hit = np.cumsum(hit)
            inside = t.whole(self.window)
            n = len(inside)
            if n:
                inside &= hit[self.period : self.period + n] > hit[:n]
            here = np.flatnonzero(inside)
            places.append(here)
            keys.append(window_hashes(t.hashes, self.window, 2)[here])
            buckets.append(self._split(window_hashes(t.hashes, self.window, 3)[here]))
            ids.append(self._ids_of(first, t, here))
        flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (buckets, keys)]
        own = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        return *self._grouped(*flat, own), places, own


def _bits(bucket: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(len(bucket), bool)
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for s, e in zip([0, *edges], [*edges, len(bucket)], strict=True):
        if e > s and (told := answers.get(int(bucket[s]))) is not None:
            out[s:e] = np.unpackbits(np.frombuffer(told, np.uint8), count=e - s).view(bool)
    return out


def _runs(bucket: np.ndarray):
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for s, e in zip([0, *edges], [*edges, len(bucket)], strict=True):
        if e > s:
            yield int(bucket[s]), int(s), int(e)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy().astype(np.int64)


def drop_repeats(docs: DataFrame, window: int = 13, text: str = "text", doc_id: str = "doc_id", spans: str = "removed_spans") -> DataFrame:
    """Remove from each text every word covered by a ``window``-word run whose word sequence also starts in a document
    with a smaller id; windows are judged on the input.

    Returns the rows and columns of ``docs``, with the kept text in column ``text`` and ``n_words``, ``n_removed`` (long)
    and ``spans`` (array of begin, end: word places removed) added; a text without removals is unchanged, else its kept
    runs of words stand as they were, joined by one line feed.

    Null text: null, no words.  Texts shorter than the window and empty tables: nothing is removed.  Rows with equal ids
    count as one document: none of them gives the others a reason to lose words.  Null ids rank behind all others.  Ids are
    whole numbers; others are an error.
    Columns of ``docs`` that have the names of added columns are replaced.
    """
    if docs.schema[doc_id].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{doc_id} is not a whole number")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"n_words", "n_removed", spans.lower()}])
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks, buckets = size // BLOCK + 1, size // BUCKET + 1
    block = fresh(docs, "block")
    rows = docs.withColumn(block, F.pmod(F.xxhash64(doc_id, text), F.lit(blocks)).cast("int"))
    dealt = rows.groupBy(block)

    def made(t: pa.Table) -> tuple[int, Block]:
        return t.column(block)[0].as_py(), Block(_ids(t.column(doc_id)), t.column(text).cast(pa.binary()).to_pylist(), window, buckets)

    def ask_anchors(t: pa.Table) -> pa.Table:
        own, b = made(t)
        bucket, key, *_ = b.anchor_keys()
        out = [(s, own, key[i:j].tobytes()) for s, i, j in _runs(bucket)]
        return _table(out)

    def answer_anchors(t: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, np.uint32) for x in t.column("keys").to_pylist()]
        _, back, n = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        return _answer(t, sent, (n > 1)[back])

    def ask_windows(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _table([])
        own, b = made(t)
        bucket, key, low, *_ = b.windows(_told(told, 0))
        return _table([(s, own, key[i:j].tobytes() + low[i:j].tobytes()) for s, i, j in _runs(bucket)])

    def answer_windows(t: pa.Table) -> pa.Table:
        halves = [(x[: len(x) // 2], x[len(x) // 2 :]) for x in t.column("keys").to_pylist()]
        sent = [np.frombuffer(k, np.uint64) for k, _ in halves]
        low = np.concatenate([np.frombuffer(i, np.int64) for _, i in halves])
        keys = np.concatenate(sent)
        order = np.argsort(keys, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0)))
        least = np.minimum.reduceat(low[order], new)
        smaller = np.empty(len(keys), bool)
        smaller[order] = np.repeat(least, np.diff([*new, len(keys)])) < low[order]
        return _answer(t, sent, smaller)

    names = rows.columns
    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(spans, span)])
    at = {c: i for i, c in enumerate(names)}

    def cut(t: pa.Table, told: pa.Table) -> pa.Table:
        cols = [t.column(i) for i in range(len(names))]
        n_words, n_removed, spans_, texts = [], [], [], []
        if t.num_rows:
            _, b = made(t)
            bucket, _, low, _, group, places, own = b.windows(_told(told, 0))
            gone = _bits(bucket, _told(told, 1))[group] | (own > low[group]) if len(group) else np.zeros(0, bool)
            done = 0
            null = t.column(text).is_null().to_pylist()
            for (first, x), here in zip(b.parts, places, strict=True):
                bad = covered(here[gone[done : done + len(here)]], window, len(x.starts))
                done += len(here)
                for i in range(len(x.offsets) - 1):
                    lo, hi = int(x.first[i]), int(x.first[i + 1])
                    n_words.append(hi - lo)
                    out = bad[lo:hi]
                    n_removed.append(int(out.sum()))
                    edge = np.diff(np.concatenate(([0], out.view(np.int8), [0])))
                    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    spans_.append([{"begin": int(p), "end": int(q)} for p, q in zip(begin, end, strict=True)])
                    if null[first + i]:
                        texts.append(None)
                    elif not len(begin):
                        texts.append(x.data[x.offsets[i] : x.offsets[i + 1] - 1])
                    else:
                        keep = [(p, q) for p, q in zip([0, *end], [*begin, hi - lo], strict=True) if q > p]
                        texts.append(b"\n".join(x.data[x.starts[lo + p] : x.ends[lo + q - 1]] for p, q in keep))
            cols[at[text]] = pa.array(texts, pa.binary()).cast(pa.string())
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        keep = [i for i, c in enumerate(names) if c != block]
        return pa.table([*(cols[i] for i in keep), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans_, kind)], names=[*(names[i] for i in keep), "n_words", "n_removed", spans])

    sent = "bucket int, block int, keys binary"
    back = "block int, step int, bucket int, bits binary"
    anchors = dealt.applyInArrow(ask_anchors, sent).groupBy("bucket").applyInArrow(answer_anchors, back)
    windows = dealt.cogroup(anchors.groupBy("block")).applyInArrow(ask_windows, sent).groupBy("bucket").applyInArrow(answer_windows, back)
    told = anchors.union(windows.withColumn("step", F.lit(1)))
    return dealt.cogroup(told.groupBy("block")).applyInArrow(cut, schema)


def _table(rows: list) -> pa.Table:
    bucket, block, keys = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "block": pa.array(block, pa.int32()), "keys": pa.array(keys, pa.binary())})


def _answer(t: pa.Table, sent: list, yes: np.ndarray) -> pa.Table:
    edges = np.cumsum([0, *map(len, sent)])
    bits = [np.packbits(yes[i:j]).tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
    n = len(bits)
    return pa.table({"block": t.column("block"), "step": pa.array([0] * n, pa.int32()), "bucket": t.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _told(t: pa.Table, step: int) -> dict[int, bytes]:
    return {b: x for s, b, x in zip(t.column("step").to_pylist(), t.column("bucket").to_pylist(), t.column("bits").to_pylist(), strict=True) if s == step}
