"""Near copies by SimHash, checked by the Jaccard similarity of word shingles.

Texts with the same set of shingles are one unit.  Units whose fingerprints are linked in the Gray-order index of ``simhash``
are compared first, shingle by shingle, and those that are similar enough are joined.  Near copies whose fingerprints differ
in more bits are then looked for among min-hashes: ``BANDS`` bands of ``ROWS`` min-hashes each put units into buckets; a
pair of similarity ``s`` shares no bucket with probability ``(1 - s ** ROWS) ** BANDS``, 4e-5 at 0.8.  (Fingerprints of such
pairs differ in up to 15 of 64 bits; at that width the Gray-order index prunes next to nothing.)  Each unit
carries its number of shingles and the parity of its shingles over at least twice as many bits: two parities never differ in
more places than the sets do, so this test drops no pair that is similar enough, and leaves few below a similarity of 0.78.
What is left is listed once, in the first bucket of a pair, and compared shingle by shingle.  The
first round lists one pair for each two groups that it joins, so a large group of near copies never has its pairs listed;
the second one lists every pair that the pairs found true so far leave unconnected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import _LOWER, _link, components, fingerprint, linked
from .store import fresh, written
from .words import mix

#: Words in a shingle, least similarity, bands and min-hashes in each.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 14, 3
#: Least and most bits of a parity; rows of (unit, band), about 400 bytes each, that a group of buckets has on average; words of
#: parities compared at once.
PARITY, WIDEST, GROUP, WORDS = 256, 1 << 16, 1 << 16, 1 << 20
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))[:, None]


def shingles(text: bytes | None, shingle: int = SHINGLE) -> set[bytes]:
    """The shingles whose hashes ``fingerprint`` counts; without words none."""
    words = (text or b"").translate(_LOWER).split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def jaccard(a: set, b: set) -> float:
    """Share of common elements; of two empty sets 1."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def _features(text: str | None, shingle: int) -> tuple[int, int, bytes, list[int]]:
    h = xxhash.xxh64_intdigest
    found = shingles(None if text is None else text.encode(), shingle)
    hashes = np.unique(np.fromiter((h(s, 42) for s in found), np.uint64, len(found)))
    bits = min(WIDEST, max(PARITY, 1 << (2 * len(hashes) - 1).bit_length())) if len(hashes) else PARITY
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    least = np.full(len(_SEEDS), 0, np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        part = mix(hashes[None, i : i + (1 << 12)] ^ _SEEDS).min(axis=1)
        least = np.minimum(least, part) if i else part
    bands = [h(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))]
    signed = np.array([h(hashes.tobytes()), *bands], np.uint64).view(np.int64).tolist()
    return signed[0], len(hashes), np.packbits(odd.astype(bool)).tobytes(), signed[1:]


class Parities:
    """Parities over numbers of bits that are powers of two.  A wide one folded in the middle is the one over half as many
    bits, so two are compared over the bits of the narrower one; ``at`` has the parities of all rows that are wide enough."""

    def __init__(self, rows: list[bytes]):
        self.words = np.array([len(r) // 8 for r in rows], np.int64)
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        wider, folded = np.zeros(0, np.int64), None
        w = int(self.words.max(initial=PARITY // 64))
        while w >= PARITY // 64:
            own = np.flatnonzero(self.words == w)
            bits = np.frombuffer(b"".join([rows[i] for i in own]), np.uint64).reshape(-1, w)
            wider, bits = np.concatenate([wider, own]), bits if folded is None else np.concatenate([folded, bits])
            place = np.full(len(rows), -1, np.int32)
            place[wider] = np.arange(len(wider))
            self.at[w], folded = (place, bits), bits[:, : w // 2] ^ bits[:, w // 2 :]
            w //= 2

    def near(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Of which pairs do the parities differ in ``most`` places or fewer?"""
        ok = self._within(PARITY // 64, a, b, most)
        least = np.minimum(self.words[a], self.words[b])
        for w in np.unique(least[ok]):
            k = np.flatnonzero(ok & (least == w))
            ok[k] = self._within(int(w), a[k], b[k], most[k])
        return ok

    def _within(self, w: int, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        (place, bits), step = self.at[w], max(1, WORDS // w)
        found = [np.bitwise_count(bits[place[a[i : i + step]]] ^ bits[place[b[i : i + step]]]).sum(axis=1, dtype=np.int64) <= most[i : i + step] for i in range(0, len(a), step)]
        return np.concatenate([np.zeros(0, bool), *found])


def pairs(bucket: np.ndarray, key: np.ndarray, label: np.ndarray, n: np.ndarray, parity: list[bytes], bands: np.ndarray, similarity: float, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of candidates: pairs of one bucket (rows with equal ``bucket`` are neighbours) in different groups (``label``) that
    sizes and parities leave possible; with ``every`` all of them, otherwise enough to connect what all of them would.  A
    pair is listed in its first bucket alone (``bands`` has a row's buckets)."""
    _, first, of = np.unique(label, return_index=True, return_inverse=True)
    parent = first[of]
    n = n.astype(np.float64)
    parities = Parities(parity)
    none = np.zeros(0, np.int64)
    out = [(none, none)]
    p, step = np.arange(len(bucket)), 0
    while len(p):
        step += 1
        p = p[p + step < len(bucket)]
        p = p[bucket[p] == bucket[p + step]]
        a, b = p, p + step
        # of two sets at the least similarity so many elements are in one only
        most = (n[a] + n[b]) * ((1 - similarity) / (1 + similarity)) + 1e-6
        ok = (parent[a] != parent[b]) & (np.abs(n[a] - n[b]) <= most)
        a, b, most = a[ok], b[ok], most[ok]
        ok = parities.near(a, b, most)
        a, b = a[ok], b[ok]
        if not every and len(a):
            low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
            at = np.unique(low * len(n) + high, return_index=True)[1]
            a, b = a[at], b[at]
            parent = _link(parent, a, b)
        here = bands[a, (bands[a] == bands[b]).argmax(axis=1)] == bucket[a]  # elsewhere it is listed or connected
        out.append((a[here], b[here]))
    a, b = (np.concatenate([x[k] for x in out]) for k in (0, 1))
    return key[a], key[b]


def candidates(units: DataFrame, similarity: float, every: bool, group: int = GROUP) -> DataFrame:
    """``pairs`` (u, v) of all ``units`` (key, label, n, parity, bands); only buckets with several groups are looked into."""
    rows = units.select("key", "label", F.explode("bands").alias("bucket"))
    several = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
    held = written(rows.join(several, "bucket", "left_semi").groupBy("key").agg(F.collect_list("bucket").alias("buckets")), "buckets")  # ``BANDS`` at most
    k = max(64, -(-(held.agg(F.sum(F.size("buckets"))).first()[0] or 0) // group))

    def each(t: pa.Table) -> pa.Table:
        longs = {c: t.column(c).to_numpy().astype(np.int64) for c in ("bucket", "key", "label", "n")}
        bands = t.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, BANDS)
        order = np.lexsort((longs["key"], longs["bucket"]))
        parity = t.column("parity").take(pa.array(order)).to_pylist()
        u, v = pairs(*(x[order] for x in longs.values()), parity, bands[order], similarity, every)
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    rows = units.join(held, "key").select("key", "label", "n", "parity", "bands", F.explode("buckets").alias("bucket"))
    found = rows.groupBy(F.pmod(F.xxhash64("bucket"), F.lit(k)).alias("g")).applyInArrow(lambda t: each(t), "u long, v long")
    return written(found.distinct(), "candidates")


def print_pairs(units: DataFrame, bits: int = 4) -> DataFrame:
    """Pairs (u, v) of keys of ``units`` (key, fp) that connect units with one fingerprint and, through the Gray-order index, those
    whose fingerprints are linked at ``bits`` or fewer differences."""
    named = written(units.groupBy("fp").agg(F.min("key").alias("key")), "prints")
    same = units.select("key", "fp").join(named.select("fp", F.col("key").alias("first")), "fp").filter("key <> first").select("key", "first")
    at = lambda c: named.select(F.col("fp").alias(c), F.col("key").alias(f"{c}_key"))
    near = linked(named.select("fp"), bits).distinct().join(at("u"), "u").join(at("v"), "v").select(F.col("u_key").alias("key"), F.col("v_key").alias("first"))
    return same.union(near).select(F.least("key", "first").alias("u"), F.greatest("key", "first").alias("v")).filter("u <> v").distinct()


def verified(asked: DataFrame, units: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of ``asked`` whose texts are at least so similar; ``texts`` has a text for each ``t`` of ``units``."""
    needed = asked.select(F.col("u").alias("key")).union(asked.select("v")).distinct().join(units.select("key", "t"), "key")
    held = written(texts.join(needed, "t").groupBy("key").agg(F.min("text").alias("text")), "texts")

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        of = lambda t: shingles(None if t is None else t.encode(), shingle)
        return pd.Series([jaccard(of(x), of(y)) >= similarity for x, y in zip(a, b, strict=True)], dtype="bool")

    with_both = asked.join(held.select(F.col("key").alias("u"), F.col("text").alias("one")), "u").join(held.select(F.col("key").alias("v"), F.col("text").alias("two")), "v")
    return written(with_both.filter(same("one", "two")).select("u", "v"), "near")


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id`` and ``component_id``, the smallest id reachable over pairs of texts with a
    Jaccard similarity of ``similarity`` or more that linked fingerprints or a shared bucket name.

    Texts without words are equal to each other.  Null ids never name a component; one that has no other id is null."""

    @F.pandas_udf("key long, n long, parity binary, bands array<long>, fp long")
    def features(texts: pd.Series) -> pd.DataFrame:
        made = pd.DataFrame([_features(t, shingle) for t in texts], columns=["key", "n", "parity", "bands"])
        prints = np.array([fingerprint(None if t is None else t.encode()) for t in texts], np.uint64)
        return made.assign(fp=prints.view(np.int64))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("t"))
    prints = written(rows.withColumn("x", features("text")).select("doc_id", "t", "x.*"), "features")
    units = written(prints.groupBy("key").agg(F.min("doc_id").alias("low"), F.min("t").alias("t"), F.min("n").alias("n"), F.min("parity").alias("parity"), F.min("bands").alias("bands"), F.min("fp").alias("fp")), "units")

    def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
        """``labels`` (key, label) with groups made one that ``links`` (u, v) connect; only groups, not their members, are linked."""
        at = lambda c: labels.select(F.col("key").alias(c), F.col("label").alias(f"{c}_label"))
        roots = components(links.join(at("u"), "u").join(at("v"), "v").select(F.col("u_label").alias("u"), F.col("v_label").alias("v")))
        return written(labels.join(roots, labels.label == roots.node, "left").select("key", F.coalesce("root", "label").alias("label")), "labels")

    labels = joined(units.select("key", F.col("key").alias("label")), verified(print_pairs(units), units, rows, shingle, similarity))
    for every in (False, True):
        labels = joined(labels, verified(candidates(units.join(labels, "key"), similarity, every), units, rows, shingle, similarity))
    labels = labels.join(units.select("key", "low"), "key")
    named = labels.join(labels.groupBy("label").agg(F.min("low").alias("component_id")), "label").select("key", "component_id")
    return prints.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest id.

    Rows with a null id, and all rows that share the kept id, stay."""
    gone = near_groups(docs, similarity, shingle, text, doc_id).filter("component_id < doc_id").select(F.col("doc_id").alias(key := fresh(docs, "gone"))).distinct()
    return docs.join(gone, docs[doc_id] == gone[key], "left_anti")
