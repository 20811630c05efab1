"""Repair of conversations against an exhaustive search, the spilled path against the plain one, and edge cases."""

import hashlib
import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakesearch.llm import structure_repair as sr

SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, block string"
WHOLE = re.compile(r"(s?(ua)+)?\Z")


def spelled_out(rows):
    """(audit, cost, lines) by trying every string of edits of (role, text, dead, cut)."""
    best = None
    per_row = []
    for role, _, dead, cut in rows:
        ways = [("D", 2, "")]
        if not dead:
            more = 5 if cut else 0
            ways += [("K", more, role[:1] or " "), ("R", more + 1, "u"), ("R", more + 1, "a")]
        per_row.append(ways)
    gaps = [("", 0, ""), ("I", 5, "u"), ("I", 5, "a"), ("II", 10, "ua"), ("II", 10, "au")]
    for choice in itertools.product(*per_row):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            parts = [x for pair in zip(ins, choice, strict=False) for x in pair] + [ins[-1]]
            if WHOLE.match("".join(p[2] for p in parts)):
                found = sum(p[1] for p in parts), "".join(p[0] for p in parts)
                best = found if best is None else min(best, found)
    return best


ROW = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.just("t"), st.booleans(), st.booleans())


@settings(max_examples=60, deadline=None)
@given(st.lists(ROW, max_size=3))
def test_edits_are_the_cheapest_and_least(rows):
    state, cost, back = sr.START, 0, sr.array("I")
    for role, _, dead, cut in rows:
        state, paid, b = sr.step(state, role[:1] if role[:1] in ("s", "u", "a") else "", dead, cut)
        cost += paid
        back.append(b)
    more, end, tail = sr.finish(state)
    start, made = sr._made(back, end, tail, [r[0] for r in rows], [r[1] for r in rows])
    assert start == sr.NOTHING and (cost + more, made["audit"]) == spelled_out(rows)
    assert WHOLE.match("".join(r[:1] for r, _ in made["turns"]))


def chat(conv_id, n, seed):
    import random

    rng = random.Random(seed)
    out = []
    for turn in range(n):
        role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool"])
        text = rng.choice(["Fine.", f"Point {turn}.", f"cut {turn}", " \n", "Why?"])
        out.append((conv_id, None if rng.random() < 0.1 else turn, role, text, rng.random() < 0.1, "x"))
    return out


@pytest.mark.parametrize("held", [(1, 1 << 20), (3, 1 << 20), (1000, 12)])
def test_spilled_conversations_end_as_others(spark, held):
    rows = [r for c in range(12) for r in chat(c, 5 * c, c)]
    turns = spark.createDataFrame(rows, SCHEMA)
    whole = sr.digests(sr.repair(turns, gone="gone")).toPandas().sort_values("conv_id").reset_index(drop=True)
    parts = sr.repair(turns, *held, gone="gone")
    assert parts.filter("block > 0").count() > 3
    got = sr.digests(parts).toPandas().sort_values("conv_id").reset_index(drop=True)
    assert got.equals(whole)


def test_edge_cases(spark):
    rows = [
        (1, None, None, None, False, "x"), (1, None, "user", "Null first.", False, "x"), (1, 0, "assistant", "Yes.", False, "x"),
        (2, 0, "user", "Hi.", True, "x"),
        (None, 5, "user", "A.", False, "x"), (None, 5, "user", "A.", False, "x"), (None, 9, "assistant", "B" * 100_000 + "!", False, "x"),
        (3, 1, "user", "Same.", False, "x"), (3, 1, "assistant", "Tied.", False, "x"), (3, 2, "user", "Same.", False, "x"), (3, 7, "assistant", "open", False, "x"),
    ]
    found = {r.conv_id: r for r in sr.digests(sr.repair(spark.createDataFrame(rows, SCHEMA), gone="gone")).collect()}
    assert set(found) == {1, 2, None, 3}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found[2].asDict() == {"conv_id": 2, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": digest("")}
    assert (found[1].audit, found[1].blank, found[1].cost, found[1].gaps) == ("DKK", 1, 2, 0)
    assert (found[None].audit, found[None].duplicate, found[None].gaps) == ("KDK", 1, 3)
    assert found[None].repaired_sha256 == digest("user:A.\nassistant:" + "B" * 100_000 + "!")
    # assistant before user at turn 1, then the repeated text, then a truncated end
    assert (found[3].audit, found[3].duplicate, found[3].truncated, found[3].gaps, found[3].illegal) == ("RRDD", 1, 1, 4, 1)
    assert not sr.digests(sr.repair(spark.createDataFrame([], SCHEMA), gone="gone")).collect()
    odd = spark.createDataFrame([(1, 0, "user", "A.", "no", 5), (1, 1, "assistant", "B.", "no", 5)], "conv_id long, turn long, role string, text string, gone string, h1 int")
    assert sr.digests(sr.repair(odd)).first().audit == "KK"
