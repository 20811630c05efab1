"""Personal data: the seeds against the plain expressions, the graph against loops over dictionaries, discovery and edge cases."""

import hashlib
import re
from collections import defaultdict

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from lakesearch.llm import pii
from lakesearch.llm.queries import op12_pii

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_seeds(text):
    out = []
    for kind, expression in enumerate(PLAIN):
        for m in re.finditer(expression, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
            if kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split(".")) or kind == 2 and 14 <= len(d) <= 19 and luhn or kind == 3 and 10 <= len(d) <= 15:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text("ab09.@-+ ()\n%é", max_size=60))
@example("a@b.c@d.e x@@y.zz a@b.c.@q.r")
@example("1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.4")
@example("4111 1111 1111 1111-5 +1 (017) 555-7713.")
def test_seeds_are_the_plain_matches(text):
    assert [(m["start"], m["kind"], m["end"]) for m in pii.mentions(text)[0]] == plain_seeds(text)


def plain_find(rows):
    """Spans of each (doc_id, text) with the graph in dictionaries."""
    found = [(d, *pii.mentions(t)) for d, t in rows]
    edges, belief, may = defaultdict(set), defaultdict(lambda: [0.0] * 4), defaultdict(set)
    for _, base, others in found:
        for m in base:
            belief[m["thing"]][m["kind"]] = 1.0
        for m in others:
            may[m["thing"]].update(m["kinds"])
        for m in [*base, *others]:
            for p in m["patterns"]:
                edges[p].add(m["thing"])
    sure = {t: list(b) for t, b in belief.items()}
    for _ in range(pii.ROUNDS):
        lent = defaultdict(lambda: [1.0] * 4)
        for things in edges.values():
            for k in range(4):
                total = sum(belief[t][k] for t in things)
                if total >= pii.SUPPORT and total >= pii.CONFIDENT * (len(things) + pii.UNSEEN):
                    for t in things:
                        lent[t][k] *= 1 - min(total / (len(things) + pii.UNSEEN), 0.99)
        for t, ks in may.items():
            belief[t] = [max(sure.get(t, [0.0] * 4)[k], 1 - lent[t][k] if k in ks else 0.0) for k in range(4)]
    out = []
    for d, base, others in found:
        spans = [(m["start"], m["kind"], m["end"]) for m in base]
        for m in others:
            ok = [(-belief[m["thing"]][k], k) for k in sorted(may[m["thing"]]) if belief[m["thing"]][k] >= pii.ACCEPT]
            spans += [(m["start"], min(ok)[1], m["end"])] if ok else []
        out.append((d, sorted(spans)))
    return sorted(out)


TEXTS = [(i, f"Call me: my phone is +49 170 {i}555 1{i}33 today.\nServer ip = 10.0.{i}.7 up. Mail to anna.{i}@post.example now") for i in range(9)] + [
    (50, "Call me: my phone is 0171 555 9922 today."), (51, "Server ip = 10[.]0[.]9[.]9 up. Also 2001:db8::1 down."), (52, "Mail to bob (at) post.example now"), (53, "We sold 123 4567 89 items today and 0171 555 9922 again"),
    (54, "jane at post dot example"), (55, None), (56, ""), (57, "Call me: my phone is 0171 555 9922 today."),
]


def test_the_graph_discovers(spark):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in TEXTS], "doc_id long, text string, kind string, base int").repartition(3)
    got = sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in pii.find(docs).collect())
    assert got == plain_find(TEXTS)
    said = {d: [(pii.KINDS[k], TEXTS_BY_ID[d][s:e]) for s, k, e in spans] for d, spans in got}
    assert said[50] == [("phone", "0171 555 9922")] and said[53] == [("phone", "0171 555 9922")]
    assert said[51] == [("ip", "10[.]0[.]9[.]9")] and said[52] == [("email", "bob (at) post.example")]
    assert said[54] == said[55] == said[56] == []


TEXTS_BY_ID = dict(TEXTS)


def test_edge_cases(spark):
    long = "x" * 200_000 + " a@b.example " + "9" * 100_000 + "\n" + "字" * 50_000 + "@" * 50_000 + "1." * 50_000
    rows = [(1, long), (1, long), (None, "b@c.example"), (None, None), (2, "+1 (017) 555-7713 and 1 017 555 7713")]
    got = sorted((r.doc_id or 0, len(r.base), [tuple(s) for s in r.spans]) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [g[:2] for g in got] == [(0, 0), (0, 1), (1, len(plain_seeds_of_long(long))), (1, len(plain_seeds_of_long(long))), (2, 1)]
    # a number that is known with a plus sign is known without it
    assert got[-1][2] == [(0, 3, 17), (22, 3, 36)]
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plain_seeds_of_long(long):
    return [(m["start"], m["kind"], m["end"]) for m in pii.mentions(long)[0]]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_on_the_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    name = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    got = {r.doc_id: r for r in op12_pii(spark, f"/root/testdata/{sf}").collect()}
    for d, spans in plain_find(rows):
        assert got[d].spans == name(spans)
    for d, t in rows:
        base = plain_seeds(t or "")
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
        assert got[d].base_sha256 == hashlib.sha256(name(base).encode()).hexdigest()
    assert len(got) == len(rows)
