"""

All frames carry ``doc_id``; lines have ``line_no`` (1-based) and ``line``; blocks have ``block_no``, ``heading_path``,
``start_line``, ``end_line`` and ``text``.  Windows and groups are by document, so one shuffle by document serves a chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..functions import base_title, style_level, trim_all

MAX_LINE_BYTES = 4 << 20
SCAN_BYTES = 20
#: Marks of fences that are followed at once.
MARKS = 256


def _doc() -> WindowSpec:
    return W.partitionBy("doc_id")


def _so_far() -> WindowSpec:
    return _doc().orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)


def explode_lines(docs: DataFrame) -> DataFrame:
    """B1: lines of ``docs`` (doc_id, text); CR before LF goes, a last line end adds no line, '' and null have none."""
    text = F.regexp_replace("text", r"\r?\n\z", "")
    lines = F.when(F.length("text") > 0, F.split(text, r"\r?\n"))
    found = docs.select("doc_id", F.posexplode(lines).alias("i", "line"))
    return found.select("doc_id", (F.col("i") + 1).alias("line_no"), "line")


def has_overlong_line(text: Column, limit: int = MAX_LINE_BYTES) -> Column:
    """B1: does a line have more bytes than the limit?  Such a document's extraction counts as failed."""
    return (F.octet_length(text) > limit) & F.exists(F.split(text, "\n"), lambda line: F.octet_length(line) > limit)


def skip_frontmatter(lines: DataFrame) -> DataFrame:
    """B2: without the lines from a first ``---`` to the next ``---`` or ``...``; never closed: without all lines."""
    mark = trim_all(F.col("line"))
    opens = F.max(F.when((F.col("line_no") == 1) & (mark == "---"), True)).over(_doc())
    end = F.min(F.when((F.col("line_no") > 1) & mark.isin("---", "..."), F.col("line_no"))).over(_doc())
    marked = lines.withColumns({"opens": F.coalesce(opens, F.lit(False)), "end": end})
    return marked.filter(~F.col("opens") | (F.col("line_no") > F.col("end"))).drop("opens", "end")


def mark_fences(lines: DataFrame) -> DataFrame:
    """With ``fenced``: in a code fence, its two marks included; only the mark that opened a fence closes it.

    What is open after a mark line is worked out in two passes over a document's marks, both linear: the first notes what is
    open before every ``MARKS``-th mark, the second starts from each of these notes.  A line then has the state of the last
    mark before it, which a window carries forward."""
    mark = F.substring(trim_all(F.col("line")), 1, 3)
    after = lambda was, m: F.when(was == "", m).when(was == m, "").otherwise(was)
    none = lambda t: F.array().cast(t)
    marks = lines.filter(mark.isin("```", "~~~")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", mark.alias("mark")))).alias("marks"))

    def note(state: Column, m: Column) -> Column:
        notes = F.when(state.i % MARKS == 0, F.concat(state.notes, F.array(state.open))).otherwise(state.notes)
        return F.struct(after(state.open, m.mark).alias("open"), (state.i + 1).alias("i"), notes.alias("notes"))

    def follow(state: Column, m: Column) -> Column:
        now = after(state.open, m.mark)
        return F.struct(now.alias("open"), F.concat(state.done, F.array(F.struct(m.line_no.alias("line_no"), now.alias("open")))).alias("done"))

    notes = F.aggregate("marks", F.struct(F.lit("").alias("open"), F.lit(0).alias("i"), none("array<string>").alias("notes")), note).notes
    parts = F.transform("notes", lambda was, i: F.struct(was.alias("open"), F.slice("marks", i * MARKS + 1, F.lit(MARKS)).alias("marks")))
    part = marks.select("doc_id", "marks", notes.alias("notes")).select("doc_id", F.explode(parts).alias("part"))
    done = F.aggregate("part.marks", F.struct(F.col("part.open").alias("open"), none("array<struct<line_no:int,open:string>>").alias("done")), follow).done
    states = part.select("doc_id", F.explode(done).alias("x")).select("doc_id", "x.line_no", "x.open")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("doc_id", "line_no") else F.col(f.name) for f in lines.schema]
    both = lines.withColumn("open", F.lit(None).cast("string")).unionByName(states.select(*blank, "open"))
    # a state stands beside its mark line, before or behind it; a mark line is in a fence either way
    so_far = F.last("open", ignorenulls=True).over(_so_far())
    fenced = mark.isin("```", "~~~") | (F.coalesce(so_far, F.lit("")) != "")
    return both.withColumn("fenced", fenced).filter("open is null").drop("open")


def parse_atx_heading(line: Column) -> tuple[Column, Column]:
    """Level (0: no heading) and text of a line."""
    found = r"(?s)^(#{1,6}) (.*)$"
    trimmed = trim_all(line)
    level = F.length(F.regexp_extract(trimmed, found, 1))
    return level, F.when(level > 0, trim_all(F.rtrim(F.regexp_extract(trimmed, found, 2), F.lit("#"))))


def with_headings(lines: DataFrame) -> DataFrame:
    """B4 for lines outside fences: with ``level`` and ``heading``."""
    level, text = parse_atx_heading(F.col("line"))
    level = F.when(F.col("fenced"), 0).otherwise(level)
    return lines.withColumns({"level": level, "heading": F.when(level > 0, text)})


def heading_path(lines: DataFrame) -> DataFrame:
    """With ``heading_path``, the live headings above a line (its own included), joined by ' > '.

    The last heading of a level is live if it stands below the last one of every higher level."""
    last = {n: F.last(F.when(F.col("level") == n, F.struct("line_no", "heading")), ignorenulls=True).over(_so_far()) for n in range(1, 7)}
    out = lines.withColumns({f"h{n}": c for n, c in last.items()})
    parts = []
    for n in range(1, 7):
        above = [F.coalesce(F.col(f"h{k}.line_no"), F.lit(0)) for k in range(1, n)]
        floor = F.greatest(*above) if len(above) > 1 else (above[0] if above else F.lit(0))
        parts.append(F.when((F.col(f"h{n}.line_no") > floor) & (F.col(f"h{n}.heading") != ""), F.col(f"h{n}.heading")))
    return out.withColumn("heading_path", F.concat_ws(" > ", *parts)).drop(*[f"h{n}" for n in range(1, 7)])


def _joined(order: str, value: str, separator: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), separator)


def sectionize_blocks(lines: DataFrame) -> DataFrame:
    """A block begins at each heading; texts are trimmed and blank blocks dropped; ``block_no`` counts headings."""
    numbered = lines.withColumn("block_no", F.sum((F.col("level") > 0).cast("int")).over(_so_far()).cast("int"))
    blocks = numbered.groupBy("doc_id", "block_no").agg(
        F.min_by("heading_path", "line_no").alias("heading_path"),
        F.min("line_no").alias("start_line"),
        F.max("line_no").alias("end_line"),
        trim_all(_joined("line_no", "line")).alias("text"),
    )
    return blocks.filter("text <> ''")


def markdown_lines(docs: DataFrame) -> DataFrame:
    """B1 to B5 in a row."""
    return heading_path(with_headings(mark_fences(skip_frontmatter(explode_lines(docs)))))


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of markdown documents (doc_id, text)."""
    return sectionize_blocks(markdown_lines(docs))


def resolve_title(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, title) of ``docs`` (doc_id, rel_path, given or null): given title, first level-1 heading, file name."""
    top = F.when((F.col("level") == 1) & (F.col("heading") != ""), F.col("heading"))
    first = lines.groupBy("doc_id").agg(F.min_by("heading", F.when(top.isNotNull(), F.col("line_no"))).alias("heading"))
    empty = F.lit("")
    return docs.join(first, "doc_id", "left").select("doc_id", F.coalesce(F.nullif("given", empty), "heading", base_title(F.col("rel_path"))).alias("title"))


def whole_file_block(docs: DataFrame) -> DataFrame:
    """One block for a plain text or code file; blank files have none.  A projection: no shuffle."""
    text = F.regexp_replace("text", r"\r\n", "\n")
    lines = F.size(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))
    out = docs.select("doc_id", F.lit(0).alias("block_no"), F.lit("").alias("heading_path"), F.lit(1).alias("start_line"), lines.alias("end_line"), F.regexp_replace(text, r"\n+\z", "").alias("text"))
    return out.filter(trim_all(F.col("text")) != "")


def pages_to_blocks(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of ``pages`` (doc_id, page_no, text) with running line numbers, and (doc_id, page_no) of the pages that
    look scanned: fewer than ``SCAN_BYTES`` bytes of text, or null (unreadable)."""
    trimmed = pages.withColumn("text", trim_all(F.col("text")))
    scanned = F.coalesce(F.octet_length("text") < SCAN_BYTES, F.lit(True))
    before = W.partitionBy("doc_id").orderBy("page_no").rowsBetween(W.unboundedPreceding, -1)
    n = F.size(F.split("text", "\n"))
    kept = trimmed.filter(~scanned).withColumn("n", n).withColumn("start_line", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).cast("int"))
    blocks = kept.select("doc_id", F.col("page_no").alias("block_no"), F.concat(F.lit("Page "), "page_no").alias("heading_path"), "start_line", (F.col("start_line") + F.col("n") - 1).alias("end_line"), "text")
    return blocks, trimmed.filter(scanned).select("doc_id", "page_no")


def paragraphs_to_blocks(paragraphs: DataFrame) -> DataFrame:
    """Blocks of ``paragraphs`` (doc_id, para_no, style, text); a heading style on a text that isn't blank opens one."""
    level = F.when(trim_all(F.col("text")) != "", style_level(F.col("style"))).otherwise(0)
    lines = paragraphs.select("doc_id", F.col("para_no").alias("line_no"), F.col("text").alias("line"), level.alias("level"), F.when(level > 0, trim_all(F.col("text"))).alias("heading"))
    return sectionize_blocks(heading_path(lines))


def append_ocr_blocks(blocks: DataFrame, scanned: DataFrame, transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``blocks`` with one more for each transcribed scanned page (``transcripts``: doc_id, page_no, text), placed
    after a document's last line; and (doc_id, metadata) for documents with scanned pages, listing all of them.
    Blank transcripts and ``[no text]`` give no block."""
    text = trim_all(F.col("text"))
    found = scanned.join(transcripts, ["doc_id", "page_no"]).withColumn("text", text).filter("text <> '' and text <> '[no text]'")
    last = blocks.groupBy("doc_id").agg(F.max("end_line").alias("last"))
    before = W.partitionBy("doc_id").orderBy("page_no").rowsBetween(W.unboundedPreceding, -1)
    placed = found.join(last, "doc_id", "left").withColumn("n", F.size(F.split("text", "\n")))
    placed = placed.withColumn("start_line", (F.coalesce("last", F.lit(0)) + 1 + F.coalesce(F.sum("n").over(before), F.lit(0))).cast("int"))
    more = placed.select("doc_id", F.col("page_no").alias("block_no"), F.concat(F.lit("Page "), "page_no", F.lit(" (OCR)")).alias("heading_path"), "start_line", (F.col("start_line") + F.col("n") - 1).alias("end_line"), "text")
    pages = F.array_join(F.transform(F.array_sort(F.collect_list("page_no")), lambda p: p.cast("string")), ",")
    metadata = scanned.groupBy("doc_id").agg(F.create_map(F.lit("ocr"), F.lit("vlm"), F.lit("ocr_pages"), pages).alias("metadata"))
    return blocks.unionByName(more), metadata
