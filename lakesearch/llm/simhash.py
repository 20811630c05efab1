"""SimHash near-dedup over a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank (the place of the fingerprint in the reflected Gray code), which puts
fingerprints with many equal bits side by side.  The sorted list is cut into blocks.  Within a block every group of
``FANOUT`` neighbours gets an upper node with the bits all of them share (a mask and its pattern), and so on up to a root.
Two blocks are joined by walking both hierarchies at once: the differences between the shared patterns of two nodes can
only grow further down, so a pair of nodes beyond the limit is dropped with all pairs below it.  Pairs of groups that are
connected already are dropped too, so a large group of near copies never has its pairs listed.  Of two fingerprints with
at most ``k`` differences one half has at most ``k // 2``; so the index is built twice, each half leading once, and a pair
of nodes is also dropped if its leading half differs in more than that.  A pair of blocks returns at most one link for
each fingerprint; the components of all links are found by alternating star contractions on Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh, written

#: Fingerprints in a block of the index; children of a node; pairs of nodes handled at once.
BLOCK, FANOUT, FRONTIER = 1 << 18, 2, 1 << 18
#: Blocks up to which the table of their roots may be broadcast (about 30 bytes each); beyond it Spark chooses the join.
ROOTS = 1_000_000
_CHILD = np.arange(FANOUT, dtype=np.int32)
_LEADING = np.uint64(0xFFFFFFFF00000000)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """64-bit SimHash: bit ``b`` is set if it is set in over half of the XXH64 (seed 42) values of the shingles, repeats
    included.  Words are runs outside ``\\x20``, ``\\x09-\\x0D``; A-Z are lower-cased; with fewer words than ``shingle`` the
    whole sequence is the one shingle; without words (null, empty) the fingerprint is zero."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[s:e], 42) for s, e in zip(starts, ends, strict=True)], np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        total += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text as a (signed) long in column ``name``, an existing one replaced."""

    @F.pandas_udf("long")
    def of(texts):
        return texts.map(lambda t: np.uint64(fingerprint(None if t is None else t.encode(), shingle)).astype(np.int64)).astype("int64")

    return docs.withColumn(name, of(text))


def as_hex(fingerprint: Column) -> Column:
    """16 lowercase hex digits of a long."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in the reflected Gray code, as a long whose signed order is that of the ranks."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class Hierarchy:
    """Levels of (mask, pattern) over fingerprints in Gray order: level 0 has the fingerprints, the last one root."""

    def __init__(self, fps: np.ndarray):
        every, some = fps, fps
        self.levels = [(np.full(len(fps), ~np.uint64(0)), fps)]
        while len(every) > 1:
            at = np.arange(0, len(every), FANOUT)
            every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
            self.levels.append((~(every ^ some), every))

    def whole(self, root_of: np.ndarray) -> list[np.ndarray]:
        """For each level, the component that all fingerprints below a node are in, or -1."""
        low = high = root_of
        out = [root_of]
        for _ in self.levels[1:]:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append(np.where(low == high, low, -1))
        return out


def _settle(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _link(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        parent = _settle(parent)
        x, y = parent[a], parent[b]
        if not (apart := x != y).any():
            return parent
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])


def links(a: np.ndarray, b: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A star forest (leaf, centre) with the components of ``a`` and ``b`` (each in Gray order) under links at ``bits``
    or fewer differences, half of them at most in the leading 32 bits, between ``a`` and ``b``, or within ``a`` if ``b`` is
    ``None``.  Links of neighbours within either list are used as well; they are true links too."""
    both = a if b is None else np.concatenate([a, b])
    parent = np.arange(len(both))
    near = np.flatnonzero(np.bitwise_count(both[1:] ^ both[:-1]) <= bits)
    parent = _link(parent, near, near + 1)
    ha = Hierarchy(a)
    hb, shift = (ha, 0) if b is None else (Hierarchy(b), len(a))
    one, two = ha.whole(parent[: len(a)]), hb.whole(parent[shift : shift + len(hb.levels[0][0])])
    todo = [(len(ha.levels) - 1, len(hb.levels) - 1, np.zeros(1, np.int32), np.zeros(1, np.int32))]
    fresh_links = 0
    while todo:
        i, j, p, q = todo.pop()
        if len(p) > FRONTIER:
            half = len(p) // 2
            todo += [(i, j, p[half:], q[half:]), (i, j, p[:half], q[:half])]
            continue
        (ma, pa_), (mb, pb) = ha.levels[i], hb.levels[j]
        apart = pa_[p]
        apart ^= pb[q]
        if i:
            apart &= ma[p]
        if j:
            apart &= mb[q]
        keep = np.bitwise_count(apart & _LEADING) <= bits // 2
        p, q, apart = p[keep], q[keep], apart[keep]
        keep = np.bitwise_count(apart) <= bits
        keep &= (one[i][p] != two[j][q]) | (one[i][p] < 0)
        if b is None and i == j:
            keep &= p <= q
        p, q = p[keep], q[keep]
        if not len(p):
            continue
        if i == 0 and j == 0:
            parent = _link(parent, p, q + shift)
            fresh_links += len(p)
            if fresh_links > len(both) // 4 + 64:
                one, two, fresh_links = ha.whole(parent[: len(a)]), hb.whole(parent[shift : shift + len(hb.levels[0][0])]), 0
            continue
        down_a, down_b = i > 0 and i >= j, j > 0 and j >= i
        if down_a:
            p, q = (p[:, None] * FANOUT + _CHILD).ravel(), np.repeat(q, FANOUT)
            inside = p < len(ha.levels[i - 1][0])
            p, q = p[inside], q[inside]
        if down_b:
            p, q = np.repeat(p, FANOUT), (q[:, None] * FANOUT + _CHILD).ravel()
            inside = q < len(hb.levels[j - 1][0])
            p, q = p[inside], q[inside]
        todo.append((i - down_a, j - down_b, p, q))
    parent = _settle(parent)
    leaf = np.flatnonzero(parent != np.arange(len(both)))
    return both[leaf], both[parent[leaf]]


def _pack(t: pa.Table) -> pa.Table:
    """One row for a block: its fingerprints in Gray order, and its root, the bits that all of them share."""
    fps = t.column("fp").to_numpy().astype(np.int64).view(np.uint64)
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    every, some = np.bitwise_and.reduce(fps), np.bitwise_or.reduce(fps)
    root = np.array([~(every ^ some), every], np.uint64).view(np.int64)
    return pa.table({"block": t.column("block")[:1], "fps": pa.array([fps[np.argsort(rank)].tobytes()], pa.binary()), "mask": root[:1], "pattern": root[1:]})


def block_pairs(roots: DataFrame, bits: int) -> DataFrame:
    """(low, high) of the pairs of blocks, a block with itself among them, whose roots (block, mask, pattern; one small row for
    each block) don't rule out a link."""
    other = roots.select(F.col("block").alias("high"), F.col("mask").alias("m"), F.col("pattern").alias("p"))
    other = F.broadcast(other) if other.count() <= ROOTS else other
    apart = F.col("pattern").bitwiseXOR(F.col("p")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("m"))
    near = (F.bit_count(apart) <= bits) & (F.bit_count(F.shiftrightunsigned(apart, 32)) <= bits // 2)
    return roots.join(other, (F.col("block") <= F.col("high")) & near).select(F.col("block").alias("low"), "high")


def linked(fps: DataFrame, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between distinct fingerprints, column ``fp``, whose components are those under all links at ``bits`` or
    fewer differences.

    The roots of the blocks are compared first; fingerprints are sent only along the pairs of blocks that are left, which for
    spread-out fingerprints are those whose common leading bits differ in ``bits // 2`` places at most."""
    n = fps.count()
    k = max(1, -(-n // block), 4 * (n >= 1 << 14))

    def join(t: pa.Table) -> pa.Table:
        sides = [np.frombuffer(x, np.uint64) for x in t.sort_by("block").column("fps").to_pylist()]
        u, v = links(sides[0], sides[1] if len(sides) > 1 else None, bits)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    def turned(fp: Column) -> Column:
        return F.shiftleft(fp, 32).bitwiseOR(F.shiftrightunsigned(fp, 32))

    def by_half(fps: DataFrame) -> DataFrame:
        ranked = fps.withColumn("rank", _gray_rank(F.col("fp"))).repartitionByRange(k, "rank").select("fp", F.spark_partition_id().alias("block"))
        packed = written(written(ranked, "gray-order").groupBy("block").applyInArrow(_pack, "block int, fps binary, mask long, pattern long"), "blocks")
        pairs = written(block_pairs(packed.select("block", "mask", "pattern"), bits), "block-pairs")
        ends = pairs.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
        return ends.join(packed.select("block", "fps"), "block").groupBy("low", "high").applyInArrow(join, "u long, v long")

    lower = by_half(fps.select(turned(F.col("fp")).alias("fp")))
    return by_half(fps.select("fp")).union(lower.select(turned(F.col("u")), turned(F.col("v"))))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node of the component.

    Alternates large-star and small-star steps until all edges are stars; each round is written to the shared folder.
    """
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        edges = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        edges = written(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # stars: a node with one centre, which has none; both steps keep components, so nothing is left to do
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, bits: int = 4, shingle: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``fingerprint`` (long) and ``component_id``, the smallest id reachable
    over links between fingerprints that differ in ``bits`` or fewer bits.

    Null and empty texts have fingerprint zero and are linked like any other.  Null ids never name a component; one that
    has no other id is null.  Equal rows give equal rows.  An empty table gives an empty result.
    """
    prints = written(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle, "fp").select("doc_id", "fp"), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    roots = components(linked(classes.select("fp"), bits))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = 4, shingle: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest id.

    Rows with a null id, and all rows that share the kept id, stay.
    """
    gone = near_groups(docs, bits, shingle, text, doc_id).filter("component_id < doc_id").select(F.col("doc_id").alias(key := fresh(docs, "gone"))).distinct()
    return docs.join(gone, docs[doc_id] == gone[key], "left_anti")
