"""Decontamination, HTML and chat formatting."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakesearch.llm import chat, decontaminate, html_text

ITEMS = [
    (1, "A train leaves Berlin at 9 am with 120 passengers and travels 300 km before it stops in Munich where 20 passengers leave"),
    (2, "How many apples does Anna have if she buys 12 apples and then gives 5 apples to her brother Tom"),
    (3, "Short item of six words here"),
    (4, None),
    (5, ""),
]


def filler(rng, n):
    return " ".join("".join(rng.choice("aeioubcdfg") for _ in range(6)) for _ in range(n))


def leaks():
    rng = random.Random(1)
    around = lambda t: f"{filler(rng, rng.randrange(0, 30))} {t} {filler(rng, 20)}"
    hit = {
        10: around(ITEMS[0][1]),
        11: around(ITEMS[1][1].upper()),
        12: around("a train leaves Paris at 7 am with 99 passengers and travels 450 km before it stops in Lyon where 33 passengers leave"),
        13: around("how many apples does Maria have if she buys 40 apples and then gives 7 apples to her brother Paul"),
        14: around("Short item, of six words: here"),
        15: around("-- " + ITEMS[0][1].replace(" ", "\n") + "!"),
    }
    clean = {
        20: filler(rng, 200), 21: None, 22: "", 23: around("A train leaves the station"),
        # one value of the item stands for two here
        24: around("x " * 3 + "if she buys 12 apples"),
    }
    return hit, clean


def test_leaks_are_found_and_others_are_not(spark):
    hit, clean = leaks()
    rows = [(i, t, "d") for i, t in {**hit, **clean}.items()] + [(10, hit[10], "d"), (None, hit[10], "d"), (30, "long " * 30_000 + hit[13], "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == {(10, 1), (11, 2), (12, 1), (13, 2), (14, 3), (15, 1), (30, 2)}
    assert got[10, 1].exact and not got[12, 1].exact and got[12, 1].n_slots >= 4 and got[14, 3].matched_words == 5
    kept = decontaminate.without_matches(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, *sorted(clean)]
    assert decontaminate.matches(docs.limit(0), bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_inconsistent_values_do_not_match(spark):
    item = "take 3 red balls and 3 blue balls then add 3 green balls and put all 3 kinds of balls in one box together now"
    good, bad = item.replace("3", "8"), item
    for n in ("4", "5", "6", "7"):
        bad = bad.replace("3", n, 1)
    docs = spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.matches(docs, bench).collect()] == [1]


def test_matches_agree_with_brute_force(spark):
    """Every run of eleven template words that an item shares with a document is found: windows at all places."""
    rng = random.Random(4)
    items = [(i, filler(rng, rng.randrange(12, 40))) for i in range(20)]
    docs = []
    for d in range(60):
        w = filler(rng, 60).split()
        if d % 2:
            item = rng.choice(items)[1].split()
            a = rng.randrange(len(item) - 10)
            w[20:20] = item[a : rng.randrange(a + 11, len(item) + 1)]
        docs.append((d, " ".join(w)))
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), least=0.0)
    want = {(d, i) for d, t in docs for i, x in items if any(" ".join(x.split()[k : k + 11]) in t for k in range(len(x.split()) - 10))}
    assert want <= {(r.doc_id, r.item_id) for r in found.collect()}
    some = {(d, i) for d, t in docs for i, x in items if any(" ".join(x.split()[k : k + 8]) in t for k in range(len(x.split()) - 7))}
    assert {(r.doc_id, r.item_id) for r in found.collect()} <= some


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="top">Site name</header><nav><ul><li><a href="/">Home</a></li><li><a href="/b">Other</a></li></ul></nav><div class="cookie-notice">We use cookies. <b>OK</b></div>
<div class="ad">Buy the best of all the things now.</div><article class=post><h1>Title &amp; more</h1><p><b>First   line&nbsp;here<br>goes on &#233;.<br><p>Short.<p>A longer block of the text
 with <a href="x>y">a link</a> in it and some more words to read.</p><form><input name=q><p>Search the site</p></form><!-- <p>gone</p> --><section id="comments"><p>A reader says that this is a comment of some length.</p></section></article>
<aside><p>Related: the story of the week that everyone is talking about today.</p></aside><footer>&copy; Site. All rights.</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst line here goes on é.\n\nShort.\n\nA longer block of the text with a link in it and some more words to read."
    plain = "<p>" + "It is the story of a man who was in the town and had not been there before. " * 4 + "</p>"
    menu = "<ul><li><a href=a>One</a><li><a href=b>Two</a></ul>"
    assert html_text.main_text(menu + plain + "<p>Short.</p>" + plain + menu + "<p>tail</p>").count("\n\n") == 2
    for odd in (None, "", "   ", "<", "<p", "<!-- open", "<script>x", "</div></p>", "&#0;&bogus;"):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("just words") == ""
    long = "<article>" + "<p>word word the of and to in that</p>" * 5000 + "</article>"
    assert html_text.main_text(long).count("\n\n") == 4999


def test_main_text_on_spark(spark):
    rows = [(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, None)]
    got = html_text.with_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r.text[:5] for r in got] == ["Title", "Title", ""]
    assert html_text.with_main_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


EVENTS = "conv_id long, seq long, turn long, role string, kind string, text string"


def test_events_fold_to_final_messages(spark):
    rows = [
        (1, 1, 1, "user", "delta", "Hel"), (1, 2, 1, None, "delta", "lo"), (1, 3, 2, "assistant", "delta", "Dra"), (1, 4, 2, None, "delta", "ft"),
        (1, 6, 2, None, "delta", " two"), (1, 5, 2, "assistant", "regenerate", "Answer"), (1, 7, 1, "user", "edit", "Hi"), (1, 8, 3, "user", None, None),
        (2, 1, None, None, None, "x"), (None, 1, 1, "user", "delta", "y"),
    ]
    random.Random(0).shuffle(rows)
    events = spark.createDataFrame(rows, EVENTS)
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.final_messages(events).collect()}
    assert got == {(1, 1): ("user", "Hi"), (1, 2): ("assistant", "Answer two"), (1, 3): ("user", ""), (2, None): ("", "x"), (None, 1): ("user", "y")}
    assert chat.format_chats(events.limit(0)).count() == 0


NASTY = ["", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "\\", "\\\\<|", "<", "a<", "|im_end|>", "<<SYS>>[[INST]]", "line\n\nend\n", "é水\U0001f600", "<\\|", "x" * 50_000, "$1 \\1 \\n"]


def round_trip(spark, turns):
    rows = [(c, i, i, role, "delta", text) for c, conv in enumerate(turns) for i, (role, text) in enumerate(conv)]
    return {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, EVENTS))).collect()}


def test_texts_come_back(spark):
    turns = [[("user", a), ("assistant", b), ("sys\ntem<|", a)] for a in NASTY for b in NASTY]
    got = round_trip(spark, turns)
    for c, conv in enumerate(turns):
        assert [(t.role, t.text) for t in got[c].parsed] == conv
        assert got[c].loss_text == "".join(t for r, t in conv if r == "assistant")
        inner = got[c].formatted.split(chat.BEGIN)
        assert len(inner) == 4 and got[c].formatted.count(chat.END) == 3
        assert not any(x in s.text for s in got[c].segments for x in chat.CONTROL if s.loss)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="<|>\\/s[]INSTim_endtar\n ", max_size=30), min_size=40, max_size=40))
def test_random_texts_come_back(spark, texts):
    got = round_trip(spark, [[("user", t), ("assistant", t)] for t in texts])
    for c, t in enumerate(texts):
        assert [x.text for x in got[c].parsed] == [t, t] and got[c].loss_text == t


def test_a_hot_conversation(spark):
    rows = [(1, i, i, "assistant" if i % 2 else "user", "delta", f"text {i} <|") for i in range(5000)]
    r = chat.read_back(chat.format_chats(spark.createDataFrame(rows, EVENTS))).select("n_turns", F.sha2(F.col("loss_text"), 256).alias("h")).first()
    assert r.n_turns == 5000 and r.h == hashlib.sha256("".join(f"text {i} <|" for i in range(1, 5000, 2)).encode()).hexdigest()


@pytest.mark.parametrize("c", chat.CONTROL)
def test_control_strings_are_broken_up(spark, c):
    e = spark.range(1).select(chat.escape(F.lit(f"a{c}b")).alias("e")).first().e
    assert c not in e
