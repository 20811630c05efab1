"""Scalar functions, extraction and chunking on small inputs written by hand."""

import random
import time

import numpy as np
import pytest
from conftest import stand_in_embedder
from pyspark.sql import functions as F

from lakesearch import functions as fn
from lakesearch.operators import chunking, extract


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_queries_are_sanitised(spark):
    cases = {
        'k8s "deploy" (prod)': ["k8s", "deploy", "prod"],
        "foo-bar_baz.qux": ["foo-bar_baz.qux"],
        "--- a... -b-": ["a", "b"],
        "naïve café 水": ["naïve", "café", "水"],
        "": [],
    }
    for q, want in cases.items():
        assert one(spark, fn.sanitize_query(F.col("q")), q=q) == want
    assert one(spark, fn.match_string(F.col("q")), q="a b") == '"a" OR "b"'


def test_tokens_and_ids(spark):
    assert one(spark, fn.tokenize(F.col("t")), t="Crème brûlée, v2!") == ["creme", "brulee", "v2"]
    for t, n in (("", 0), ("abc", 1), ("abcdefgh", 2), ("é" * 8, 4)):
        assert one(spark, fn.estimate_tokens(F.col("t")), t=t) == n
    assert one(spark, fn.file_ext(F.col("p")), p="a.b/C.MD") == ".md" and one(spark, fn.base_title(F.col("p")), p="a/b.c.md") == "b.c"
    with pytest.raises(ValueError, match="two formats"):
        fn.format_of(F.lit(".a"), {"x": [".a"], "y": [".a"]})


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("**/*.md", ["a.md", "x/y/a.md"], ["a.mdx", "a/b"]),
        ("notes/*.{md,txt}", ["notes/a.md", "notes/b.txt"], ["notes/x/a.md", "notes/a.go"]),
        ("a/**", ["a/b", "a/b/c"], ["b/a"]),
        ("?[0-9][!x].go", ["a1b.go"], ["a1x.go", "ab.go"]),
    ],
)
def test_globs(spark, glob, yes, no):
    rows = spark.createDataFrame([(p,) for p in yes + no], "p string").withColumn("m", fn.glob_match(F.col("p"), glob)).collect()
    assert {r.p for r in rows if r.m} == set(yes)


def test_lines_and_relevance(spark):
    text = "a\nb\nc\nd"
    for s, e, want in ((1, 2, "a\nb"), (3, 0, "c\nd"), (0, 99, text), (3, 2, ""), (9, 0, "")):
        assert one(spark, fn.slice_lines(F.col("t"), F.lit(s), F.lit(e)), t=text) == want
    assert one(spark, fn.relevance(F.lit(2.0 / 61))) == 1.0
    assert one(spark, fn.preview(F.col("t")), t="x\n" * 150) == ("x " * 100) + "…"
    assert one(spark, fn.style_level(F.col("s")), s="Heading 3") == 3 and one(spark, fn.style_level(F.col("s")), s="heading7") == 0
    assert one(spark, fn.metadata_to_json(fn.metadata_from_json(F.col("s"))), s="{}") == "{}"
    assert one(spark, fn.metadata_matches(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(""))))


MARKDOWN = """---
tags: [x]
---
Preamble text.

# Title here

Intro.

## Section A
```
# not a heading
~~~
```
body a
### Deep
deep body
## Section B
# C#
#no-space
####### seven
"""


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_markdown(spark):
    blocks = [(r.heading_path, r.start_line, r.end_line) for r in extract.markdown_blocks(docs(spark, MARKDOWN)).orderBy("start_line").collect()]
    assert blocks == [
        ("", 4, 5), ("Title here", 6, 9), ("Title here > Section A", 10, 15), ("Title here > Section A > Deep", 16, 17), ("Title here > Section B", 18, 18), ("C", 19, 21),
    ]
    skipped = extract.markdown_blocks(docs(spark, "### Deep first\n\n# Then top\n"))
    assert [r.heading_path for r in skipped.orderBy("start_line").collect()] == ["Deep first", "Then top"]
    assert extract.markdown_blocks(docs(spark, "---\nnever closed\n# x\n", "", None, " \n ")).count() == 0
    crlf = extract.explode_lines(docs(spark, "a\r\nb\r\n", "\n", "x\n\n")).orderBy("doc_id", "line_no").collect()
    assert [(r.doc_id, r.line) for r in crlf] == [(0, "a"), (0, "b"), (2, "x"), (2, "")] or [(r.doc_id, r.line) for r in crlf] == [(0, "a"), (0, "b"), (1, ""), (2, "x"), (2, "")]
    fences = extract.mark_fences(extract.explode_lines(docs(spark, "~~~\n```\nx\n~~~\ny\n```\nz"))).orderBy("line_no").collect()
    assert [r.fenced for r in fences] == [True, True, True, True, False, True, True]
    titles = docs(spark, MARKDOWN, "no heading", "# t").withColumns({"rel_path": F.lit("n/name.md"), "given": F.when(F.col("doc_id") == 2, "Given")})
    assert [r.title for r in extract.resolve_title(titles, extract.markdown_lines(titles)).orderBy("doc_id").collect()] == ["Title here", "name", "Given"]


def test_headings_against_a_stack(spark):
    rng = random.Random(0)
    texts, want = [], []
    for _ in range(30):
        lines, stack, paths = [], [], []
        for i in range(rng.randrange(1, 25)):
            level = rng.choice([0, 1, 2, 3, 4, 6])
            if level:
                lines.append("#" * level + f" h{i}")
                stack = stack[: level - 1] + [""] * (level - 1 - len(stack)) + [f"h{i}"]
            else:
                lines.append("text")
            paths.append(" > ".join(h for h in stack if h))
        texts.append("\n".join(lines))
        want.append(paths)
    got = extract.markdown_lines(docs(spark, *texts)).orderBy("doc_id", "line_no").collect()
    for d, paths in enumerate(want):
        assert [r.heading_path for r in got if r.doc_id == d] == paths


def test_pages_and_paragraphs(spark):
    pages = spark.createDataFrame([(1, 1, "First page with enough text\nand more"), (1, 2, ""), (1, 3, None), (1, 4, "Another page with enough text")], "doc_id int, page_no int, text string")
    blocks, scanned = extract.pages_to_blocks(pages)
    assert sorted(r.page_no for r in scanned.collect()) == [2, 3]
    ocr = spark.createDataFrame([(1, 2, "read\nhere"), (1, 3, "[no text]")], "doc_id int, page_no int, text string")
    out, metadata = extract.append_ocr_blocks(blocks, scanned, ocr)
    assert [(r.heading_path, r.start_line, r.end_line) for r in out.orderBy("start_line").collect()] == [("Page 1", 1, 2), ("Page 4", 3, 3), ("Page 2 (OCR)", 4, 5)]
    assert metadata.first().metadata == {"ocr": "vlm", "ocr_pages": "2,3"}
    paragraphs = spark.createDataFrame([(1, 1, "Heading1", "Top"), (1, 2, "Normal", "a"), (1, 3, "heading 2", " "), (1, 4, "Heading2", "Sub"), (1, 5, None, "b")], "doc_id int, para_no int, style string, text string")
    got = [(r.heading_path, r.start_line, r.end_line, r.text) for r in extract.paragraphs_to_blocks(paragraphs).orderBy("start_line").collect()]
    assert got == [("Top", 1, 3, "Top\na"), ("Top > Sub", 4, 5, "Sub\nb")]


def block(spark, text, start=1):
    n = len(text.split("\n"))
    return spark.createDataFrame([(1, 0, "h", start, start + n - 1, text)], "doc_id int, block_no int, heading_path string, start_line int, end_line int, text string")


def slow_chunks(lines, limit, overlap, est=lambda x: max(1, len(x.encode()) // 4) if x else 0):
    out, cur, first, tokens, new = [], [], 0, 0, False
    for i, line in enumerate(lines):
        if tokens + est(line) > limit and cur:
            out.append((first, i - 1))
            keep, total = [], 0
            for x in reversed(cur):
                if total >= overlap:
                    break
                keep.insert(0, x)
                total += est(x)
            cur, first, tokens, new = keep, i - len(keep), total, False
        cur.append(line)
        tokens += est(line)
        new = True
    return out + ([(first, len(lines) - 1)] if new else [])


@pytest.mark.parametrize(("limit", "overlap"), [(64, 16), (32, 8), (20, 0), (5, 50)])
def test_chunks_of_large_blocks(spark, limit, overlap):
    rng = random.Random(limit)
    lines = [" ".join("word" for _ in range(rng.randrange(0, 14))) or "x" for _ in range(40)]
    got = chunking.chunk_blocks(block(spark, "\n".join(lines), 10), limit, overlap).orderBy("seq").collect()
    want = slow_chunks(lines, limit, overlap)
    assert [(r.start_line - 10, r.end_line - 10) for r in got] == want
    assert [r.text for r in got] == ["\n".join(lines[a : b + 1]).strip() for a, b in want]
    assert {x for a, b in want for x in range(a, b + 1)} == set(range(40)) and [r.seq for r in got] == list(range(len(got)))


def test_a_very_long_block_is_cut_in_linear_time(spark, tmp_path):
    lines = [f"line of some words number {i}" for i in range(80_000)]
    block(spark, "\n".join(lines)).write.parquet(str(tmp_path / "block"))
    began = time.perf_counter()
    n = chunking.chunk_blocks(spark.read.parquet(str(tmp_path / "block")), 128, 16).count()
    assert n == len(chunking.line_bounds([max(1, len(x) // 4) for x in lines], 128, 16)) and time.perf_counter() - began < 20


def test_small_blocks_stay_whole(spark):
    got = chunking.chunk_blocks(block(spark, "one\ntwo")).collect()
    assert [(r.text, r.seq, r.token_est, r.end_line) for r in got] == [("one\ntwo", 0, 1, 2)]
    assert chunking.chunk_blocks(block(spark, "  \n ")).count() == 0


def test_model_stages(spark):
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id int, seq int, text string")
    texts = spark.createDataFrame([(1, "t1", "whole"), (2, "t2", "other")], "doc_id int, title string, text string")
    got = {(r.doc_id, r.seq): r.context for r in chunking.contextualize_chunks(chunks, texts, lambda t, d, c: f"{t}|{d}|{c}").collect()}
    assert got == {(1, 0): "t1|whole|a", (1, 1): "t1|whole|b", (2, 0): ""}
    alone = chunking.contextualize_chunks(chunks, texts.limit(0), lambda *_: "never")
    assert alone.columns == [*chunks.columns, "context"] and {r.context for r in alone.collect()} == {""} and alone.count() == 3
    embed = stand_in_embedder(16)
    vectors = chunking.embed_texts(chunks, embed, 16, "text").orderBy("doc_id", "seq").collect()
    assert np.allclose([r.embedding for r in vectors], embed(["a", "b", "c"]))
    with pytest.raises(Exception, match="expected"):
        chunking.embed_texts(chunks, lambda t: np.zeros((len(t), 3)), 16, "text").collect()
