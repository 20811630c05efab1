"""Benchmark items with one changed word, at every offset of a document."""

from lakesearch.llm import decontaminate


def pairs(spark, docs, items):
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id): r.matched_words for r in found.collect()}


def test_one_changed_word_at_every_offset(spark):
    item = [f"word{chr(97 + i)}" for i in range(15)]
    docs = {}
    for k in (0, 5, 10, 14):
        changed = [*item[:k], "other", *item[k + 1 :]]
        for offset in range(8):
            docs[100 * k + offset] = " ".join([*(f"before{chr(97 + i)}" for i in range(offset)), *changed, "after"])
    got = pairs(spark, sorted(docs.items()), [(1, " ".join(item))])
    assert got == {(d, 1): 14 for d in docs}


def test_short_item_after_a_word_and_template_alone(spark):
    item = "Which of these rivers runs through the old part town today"
    docs = [(k, " ".join(["some"] * k + [item])) for k in range(1, 9)]
    docs.append((50, "they say which of these rivers runs through the valleys and fields"))
    long = item + " and how many boats can pass below its seven stone arches"
    got = pairs(spark, docs, [(1, item), (2, long)])
    assert {d for d, i in got if i == 1} >= set(range(1, 9))
    assert (50, 2) not in got and not any(i == 2 for _, i in got)


def test_small_pages_and_other_joins_change_nothing(spark, monkeypatch):
    item = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    docs = [(k, " ".join(["some"] * k + [item] + ["more"] * 7)) for k in (0, 1, 4, 5, 6, 11)]
    docs += [(20, "another text"), (20, item), (21, item[9:] + " " + item[:-9]), (22, item), (22, item)]
    want = pairs(spark, docs, [(1, item), (1, "a second text of one item that is longer than a window"), (2, item)])
    assert {(20, 1), (21, 2), (22, 1)} <= set(want)
    monkeypatch.setattr(decontaminate, "PAGE", 5)
    for small, known in ((500_000, 0), (0, 500_000), (0, 0)):
        monkeypatch.setattr(decontaminate, "SMALL", small)
        monkeypatch.setattr(decontaminate, "KNOWN", known)
        assert pairs(spark, docs, [(1, item), (1, "a second text of one item that is longer than a window"), (2, item)]) == want
