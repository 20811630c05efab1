"""The trie of conversations against one built turn by turn, with pages of any size, and its search against plain prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lakesearch.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, last boolean, page string"


def plain(rows, heads=6, group=100):
    """{(depth, prefix): result row} turn by turn."""
    by_conv = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            by_conv[conv_id].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in by_conv.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        made = tuple(own.get(c - c % group, [])[:h] + turns[h:])
        for d in range(len(made) + 1):
            members[made[:d]].append((c, len(made) == d))
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    least = {p: min(c for c, _ in m) for p, m in members.items()}
    ended = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(c for c, e in members[p] if e)).encode()).hexdigest()
    return sorted((least[p], len(p), least[p[:-1]] if p else -1, len(members[p]), len(kids[p]), leaves[p], saved[p], ended(p)) for p in members)


def made(spark, rows, page):
    out = pt.trie(*pt.rebuilt(spark.createDataFrame(rows, SCHEMA)), page=page).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out)


def chats(seed, n, longest):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(n * 3), n):
        for turn in range(rng.randint(1, longest)):
            at = None if rng.random() < 0.05 else turn
            out.append((c, at, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", None, "a"]), True, "x"))
    return out


@pytest.mark.parametrize(("seed", "n", "longest", "page"), [(1, 40, 6, 1024), (2, 30, 14, 4), (3, 25, 9, 1)])
def test_trie(spark, seed, n, longest, page):
    rows = chats(seed, n, longest)
    assert made(spark, rows, page) == plain(rows)


def test_long_conversations_copies_and_turnless_ones(spark):
    long = [(1, t, "user", f"t{t % 7}", True, "x") for t in range(300)]
    # beside the long one: a copy that leaves late, prefixes of it, ids with no turn of their own left, ties and nulls
    rows = long + [(2, t, r, x if t < 280 else "off", b, p) for _, t, r, x, b, p in long] + [(3, t, r, x, b, p) for _, t, r, x, b, p in long[:150]]
    rows += [(c, 0, "user", "alone", True, "x") for c in range(205, 240)] + [(None, 0, "user", "nobody", True, "x")]
    rows += [(400, 5, "user", "tie", True, "x"), (400, 5, "user", "tie", True, "x"), (400, 5, "assistant", "tie", True, "x"), (400, None, None, None, True, "x")]
    assert made(spark, rows, 32) == plain(rows)
    assert made(spark, [], 32) == []


def test_fattest(spark):
    pairs = [(a, b) for a in range(0, 70, 3) for b in range(a, 70)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", pt.fattest(F.col("a"), F.col("b")).alias("f")).collect()
    weight = lambda x: x & -x
    for r in got:
        assert r.f == (max(range(r.a + 1, r.b + 1), key=weight) if r.a < r.b else None)


def test_search_finds_where_strings_leave(spark):
    """Strings that aren't in the trie leave it where their longest prefix in it ends."""
    rows = chats(7, 60, 12)
    turns, _ = pt.rebuilt(spark.createDataFrame(rows, SCHEMA))
    pages = pt.strings(pt.prefixes(turns).cache()).cache()
    half = F.col("conv_id") % 2 == 0
    nodes = pt.build(pages.filter(half))
    known = {(p.depth, p.h1, p.h2) for r in pages.filter(half).collect() for p in r.points}
    for r in pt.locate(pages.filter(~half), nodes).collect():
        assert r.left == max([p.depth for p in r.points if (p.depth, p.h1, p.h2) in known], default=0)
