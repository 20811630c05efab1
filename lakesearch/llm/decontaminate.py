"""Benchmark decontamination by templates, in DataFrame functions only.

Texts are brought to a template form: lower case, letters and digits only, numbers, units after numbers and names
replaced by typed placeholders.  Windows of template words of documents are hash-joined with those of benchmark items,
both at every place; a hit gives an alignment (document place minus item place), on which the item is compared with the
document word by word.  The values that stand in the placeholders are compared, too: a question with other numbers, names
or units still matches if every value of the item goes to one value of the document throughout.

Items of at most ``window`` words are looked for with all their words but one.  Windows of placeholders alone aren't looked
for: every table of numbers has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh, written

#: Words in a window, least share of an item's words that must match.
WINDOW, LEAST = 8, 0.6
#: Windows of items up to which their table is broadcast (about 60 bytes each), and up to which their hashes alone are (about 50
#: bytes each); beyond that Spark chooses the join.
SMALL, KNOWN = 500_000, 2_000_000
#: Words on a page of a document with alignments.
PAGE = 1024
#: Units that may follow a number (fixed values).
UNITS = "kg|g|mg|km|m|cm|mm|miles?|feet|foot|inch(?:es)?|lbs?|pounds?|ounces?|litres?|liters?|ml|l|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?|mph|kmh|gb|mb|kb"
# Private-use characters that mark placeholders; text can't bring its own.
_NUMBER, _NAME, _UNIT = "\ue000", "\ue001", "\ue002"
_MARKS = "\ue000-\ue002"


def template_words(text: Column) -> Column:
    """Words of a text in template form; a placeholder is its mark followed by the value that it replaces.  A name is a
    capitalised word after a word that doesn't end a sentence.

    Null: no words."""
    t = F.regexp_replace(text, f"[{_MARKS}]", " ")
    t = F.regexp_replace(t, "(?<=[\\p{Ll},;]\\s)(\\p{Lu}\\p{L}+)", f"{_NAME}$1")
    t = F.regexp_replace(t, "(\\p{N}+(?:[.,]\\p{N}+)*)", f" {_NUMBER}$1 ")
    t = F.lower(t)
    t = F.regexp_replace(t, f"({_NUMBER}\\S+) +({UNITS})(?![\\p{{L}}\\p{{N}}])", f"$1 {_UNIT}$2")
    t = F.regexp_replace(t, f"[^\\p{{L}}\\p{{N}}{_MARKS}.,]+|[.,]+(?!\\p{{N}})|(?<!\\p{{N}})[.,]+", " ")
    return F.split(F.trim(F.coalesce(t, F.lit(""))), " +")


def _is_slot(word: Column) -> Column:
    return word.between(_NUMBER, "\ue003")


def _hashed(words: Column) -> Column:
    """A number for each word; placeholders of one type have the same."""
    return F.transform(words, lambda w: F.xxhash64(_kind(w)))


def _kind(word: Column) -> Column:
    """A word, or the mark of a placeholder."""
    return F.when(_is_slot(word), F.substring(word, 1, 1)).otherwise(word)


def _windows(width: int) -> Column:
    """Hashes, with their places, of the windows of ``width`` words of a text whose words' hashes are in the column ``hashed``."""
    places = F.when(F.size("hashed") >= width, F.sequence(F.lit(1), F.size("hashed") - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(F.xxhash64(*(F.get("hashed", i + k) for k in range(-1, width - 1))).alias("hash"), i.alias("place")))


def _in_pages(words: Column, page_words: int) -> Column:
    """Words in pages (page, words); no word: no page."""
    pages = F.sequence(F.lit(0), F.ceil(F.size(words) / page_words).cast("int") - 1)
    return F.transform(F.when(F.size(words) > 0, pages).otherwise(F.array().cast("array<int>")), lambda p: F.struct(p.alias("page"), F.slice(words, p * page_words + 1, page_words).alias("words")))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: float = LEAST, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item that it contains: ``doc_id``, ``item_id``, ``matched_words`` (of the item, on
    the best alignment), ``item_words``, ``n_slots`` (distinct placeholder values of the item there) and ``exact`` (all of
    them unchanged).

    A pair counts if one alignment covers at least ``least`` of the item's words and its placeholder values are consistent.
    Documents and items without words, and null ids, never match; repeated rows count as one; empty tables give an empty
    result.

    Windows are rows of a hash and a place; words are fetched only for alignments, in pages of ``PAGE`` words, so neither a long
    text nor one with many alignments is ever copied whole."""
    items = benchmark.select(F.col(item_id).alias("item_id"), template_words(F.col(item_text)).alias("words")).filter("item_id is not null and words[0] <> ''")
    items = items.withColumns({"n": F.size("words"), "item": F.xxhash64("words")}).dropDuplicates(["item_id", "words"])
    # a short item's first or last word may be left out: after other words the first one can look like a name
    width = F.when(F.col("n") <= window, F.greatest(F.col("n") - 1, F.least("n", F.lit(3)))).otherwise(window)
    short = [r.w for r in items.filter(F.col("n") <= window).select(width.alias("w")).distinct().orderBy("w").collect()]  # at most ``window`` numbers
    widths = list(dict.fromkeys([window, *short]))
    of_item = F.concat(*(F.when(width == n, _windows(n)).otherwise(F.array().cast("array<struct<hash:bigint,place:int>>")) for n in widths))
    asked = items.withColumn("hashed", _hashed(F.col("words"))).withColumn("width", width).select("item_id", "item", "n", "words", "width", F.explode(of_item).alias("x"))
    # a window of placeholders alone would meet every table of numbers
    asked = asked.filter(F.exists(F.slice("words", F.col("x.place"), F.col("width")), lambda w: ~_is_slot(w)))
    asked = written(asked.select("item_id", "item", "n", F.col("x.hash").alias("hash"), F.col("x.place").alias("item_place")), "item_windows")
    known = asked.select("hash").distinct()

    # rows with one id and different texts are told apart by a hash of the text
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("body")).filter("doc_id is not null")
    hashed = rows.select("doc_id", "version", _hashed(template_words(F.col("body"))).alias("hashed"))
    found = F.concat(*map(_windows, widths)) if short else _windows(window)
    held = hashed.select("doc_id", "version", F.explode(found).alias("x")).select("doc_id", "version", "x.hash", "x.place")
    if asked.count() <= SMALL:
        held = held.join(F.broadcast(asked), "hash")
    else:  # what no item has goes before anything is shuffled, as long as the hashes fit
        held = held.join(F.broadcast(known) if known.count() <= KNOWN else known, "hash", "left_semi").join(asked, "hash")
    # an alignment has a hit for each window that it shares
    key = ["doc_id", "version", "item_id", "item", "n", "shift"]
    aligned = written(held.withColumn("shift", F.col("place") - F.col("item_place")).select(*key).distinct(), "alignments")

    texts = rows.join(aligned.select("doc_id", "version").distinct(), ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"])
    pages = texts.select("doc_id", "version", template_words(F.col("body")).alias("words")).select("doc_id", "version", F.explode(_in_pages(F.col("words"), PAGE)).alias("p"))
    pages = pages.select("doc_id", "version", "p.page", F.col("p.words").alias("here"))
    # the item's words from place ``shift`` of the document on (both from 0), cut at the document's pages
    first, last = F.floor(F.greatest("shift", F.lit(0)) / PAGE).cast("int"), F.floor(F.greatest(F.col("shift") + F.col("n") - 1, F.lit(0)) / PAGE).cast("int")
    parts = aligned.withColumn("page", F.explode(F.sequence(first, last))).join(pages, ["doc_id", "version", "page"])
    start, end = F.greatest(F.col("page") * PAGE - F.col("shift"), F.lit(0)), F.least((F.col("page") + 1) * PAGE - F.col("shift"), "n")
    cut = parts.select(*key, start.alias("start"), F.slice("here", start + F.col("shift") - F.col("page") * PAGE + 1, end - start).alias("here"))
    own = items.select("item_id", "item", "words")
    beside = F.zip_with(F.slice("words", F.col("start") + 1, F.size("here")), F.col("here"), lambda was, now: F.struct(was.alias("was"), now.alias("now")))
    agree = F.filter(beside, lambda x: F.coalesce(_kind(x.was) == _kind(x.now), F.lit(False)))
    slots = F.filter("agree", lambda x: _is_slot(x.was))
    one = cut.join(own, ["item_id", "item"]).select(*key, agree.alias("agree")).select(*key, F.size("agree").alias("matched"), F.array_distinct(slots).alias("slots"))
    whole = one.groupBy(*key).agg(F.sum("matched").cast("int").alias("matched"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    whole = whole.filter(F.col("matched") >= F.ceil(F.col("n") * least))
    values = F.transform("slots", lambda s: s.was)
    whole = whole.withColumns({"n_slots": F.size(F.array_distinct(values)), "exact": F.forall("slots", lambda s: s.was == s.now)})
    good = whole.filter(F.col("n_slots") == F.size("slots"))
    best = F.max(F.struct("matched", "exact", "n_slots", "n"))
    return good.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.matched").cast("long").alias("matched_words"), F.col("b.n").cast("long").alias("item_words"), F.col("b.n_slots").cast("long").alias("n_slots"), F.col("b.exact").alias("exact"))


def without_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose id has no match; rows with a null id stay."""
    gone = matches(docs, benchmark, doc_id=doc_id, **how).select(F.col("doc_id").alias(key := fresh(docs, "gone"))).distinct()
    return docs.join(gone, docs[doc_id] == gone[key], "left_anti")
