"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target is a share of all words.  Each of its documents should appear ``target / source size`` times on average:
the whole part of that are certain copies, the fractional part is an inclusion probability ``p``.  Documents are ranked
by the odds of a uniform random number over the odds of ``p`` and taken in that order as long as the source's words stay
within the target; one more document, the one behind the cut that fills the gap best, brings them near it.  The random
numbers are hashes of seed and id, so reruns agree.

The order within a source is never laid out as a whole: sums by (source, slice of the rank) find the slice in which the
target is met, and only the documents of that slice are put in order.  What each source needs is then one cut, joined
back to the documents by source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written

#: Weights of the sources in code-point order, repeating; most copies of a document; slices of a source's ranks.
WEIGHTS, MOST, SLICES = (5, 2, 1), 3, 4096
#: Sources for which a table of targets may be broadcast (a few MB); beyond it Spark chooses the join.
SMALL = 20_000
_ADDED = {"size", "source_size", "target", "taken"}


def words_in(text: Column) -> Column:
    """Number of runs outside ``\\x20``, ``\\x09-\\x0D``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """For each ``source`` (null included) of ``sized`` (source, size): ``source_size``, ``target`` (double), whole
    ``copies`` and the fractional ``part`` of what each of its documents should take.

    Shares go by weight; a target above ``most`` times its source's size stops there and the excess is shared again by
    weight.  The fixed point has a closed form: with sources in order of size over weight, those up to some place stop,
    and the rest share what is left.  Sources are few rows, one for each distinct value."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    wheel = F.array(*(F.lit(w).cast("long") for w in weights))
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", F.element_at(wheel, (F.row_number().over(order) - 1) % len(weights) + 1))
    found = found.withColumns({
        "total": F.sum("source_size").over(W.partitionBy(F.lit(0))),
        "weights": F.sum("weight").over(W.partitionBy(F.lit(0))),
        "stopped": F.coalesce(F.sum(most * F.col("source_size")).over(by_ratio), F.lit(0)),
        "gone": F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)),
    })
    # a source stops if its share of what those before it leave is above its limit
    found = found.withColumn("stops", (F.col("total") - F.col("stopped")) * F.col("weight") > most * F.col("source_size") * (F.col("weights") - F.col("gone")))
    left = found.withColumns({
        "rest": F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), most * F.col("source_size"))).over(W.partitionBy(F.lit(0))), F.lit(0)),
        "sharing": F.col("weights") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("weight"))).over(W.partitionBy(F.lit(0))), F.lit(0)),
    })
    target = F.when(F.col("stops"), (most * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.col("rest")).cast("double") / F.col("sharing").cast("double"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return left.withColumn("target", target).withColumn("ratio", F.least(ratio, F.lit(float(most)))).select("source", "source_size", "target", F.floor("ratio").alias("copies"), (F.col("ratio") - F.floor("ratio")).alias("part"))


def _order_of(docs: DataFrame, doc_id: str) -> Column:
    """Ids in their own order, nulls first: whole numbers as longs, others as strings."""
    whole = docs.schema[doc_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))) if whole else F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 from 48 bits of an MD5 of seed and id (null: the seed alone)."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 48)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix", text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` (of the source) and ``taken`` (words the mix takes, copies
    counted) added, existing columns of these names replaced; ``taken / size`` is how often the document appears.

    Null texts have size 0 and are never taken; null sources form one source, the last.  Ids of any type that casts to a
    string will do; null ids count as one id, below all others; rows with one id share their fate, so a source may overshoot by
    their size.  Other columns keep their values, whatever their names.  An empty table gives an empty result."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in _ADDED])
    # whatever the columns are called, inside there are only these: the row itself, its source, id and size
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(source).alias("source"), _order_of(docs, doc_id).alias("id"), uniform(F.col(doc_id), seed).alias("u"), words_in(F.col(text)).alias("size"))
    # the narrow columns are needed several times, the text once more
    narrow = written(own.drop("row"), "sizes")
    goals = written(targets(narrow, weights, most), "targets")
    small = goals.count() <= SMALL
    by_source = lambda t: F.broadcast(t) if small else t

    rank = F.when((F.col("part") > 0) & (F.col("size") > 0), (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part"))))
    ranked = narrow.join(by_source(goals), narrow.source.eqNullSafe(goals.source)).select(goals.source, "id", "size", "part", rank.alias("q"), (F.col("target") - F.col("copies") * F.col("source_size")).alias("wanted")).filter("q is not null")
    ranked = ranked.withColumn("slice", F.floor(F.col("q") / (1 + F.col("q")) * SLICES))
    slices = ranked.groupBy("source", "slice").agg(F.sum("size").alias("here"), F.first("wanted").alias("wanted"))
    before = F.coalesce(F.sum("here").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slices = slices.withColumn("before", before).filter("before <= wanted").groupBy("source").agg(F.max_by(F.struct("slice", "before"), "slice").alias("at")).select("source", "at.slice", "at.before")
    inside = ranked.withColumnRenamed("source", "s").withColumnRenamed("slice", "k").join(by_source(slices), F.col("s").eqNullSafe(F.col("source")) & (F.col("k") == F.col("slice")))
    upto = F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("q", "id"))
    cuts = inside.withColumn("upto", upto)
    # the last of the slice that fits, if any, and what is still missing then
    fits = F.col("upto") <= F.col("wanted")
    cuts = cuts.groupBy("source").agg(F.max(F.when(fits, F.struct("q", "id"))).alias("cut"), F.first("slice").alias("cut_slice"), (F.first("wanted") - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.first("before"))).alias("gap"))
    cuts = cuts.withColumnRenamed("source", "s")
    # one more: of the documents behind the cut the one that fills the gap best
    off = F.abs(F.col("size") - F.col("gap"))
    behind = (F.col("slice") > F.col("cut_slice")) | ((F.col("slice") == F.col("cut_slice")) & F.coalesce(F.struct("q", "id") > F.col("cut"), F.lit(True)))
    extra = ranked.join(by_source(cuts), F.col("s").eqNullSafe(ranked.source) & behind & (off < F.col("gap"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), "q", "id")).alias("e"))
    extra = extra.select(F.col("source").alias("x"), F.struct("e.q", "e.id").alias("extra"))
    plan = goals.join(cuts, F.col("s").eqNullSafe(goals.source), "left").join(extra, F.col("x").eqNullSafe(goals.source), "left")
    plan = written(plan.select(F.col("source").alias("of"), "source_size", "target", "copies", "part", "cut", "cut_slice", "extra"), "mix")

    q = F.when((F.col("part") > 0) & (F.col("size") > 0), (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part"))))
    lower = F.floor(q / (1 + q) * SLICES) < F.col("cut_slice")
    place = F.struct(q.alias("q"), "id")
    taken = q.isNotNull() & (lower | F.coalesce(place <= F.col("cut"), F.lit(False)) | F.coalesce(place == F.col("extra"), F.lit(False)))
    out = own.join(by_source(plan), F.col("source").eqNullSafe(F.col("of")))
    return out.select("row.*", "size", "source_size", "target", (F.col("size") * (F.col("copies") + F.coalesce(taken, F.lit(False)).cast("long"))).alias("taken"))


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix|' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents),
s1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source),
s2 AS (SELECT *, CAST(CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight FROM s1),
s3 AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights,
         CAST(coalesce(sum(3 * source_size) OVER w, 0) AS BIGINT) AS stopped, CAST(coalesce(sum(weight) OVER w, 0) AS BIGINT) AS gone
       FROM s2 WINDOW w AS (ORDER BY source_size::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (total - stopped) * weight > 3 * source_size * (weights - gone) AS stops FROM s3),
s5 AS (SELECT *, total - CAST(coalesce(sum(CASE WHEN stops THEN 3 * source_size END) OVER (), 0) AS BIGINT) AS rest,
         weights - CAST(coalesce(sum(CASE WHEN stops THEN weight END) OVER (), 0) AS BIGINT) AS sharing FROM s4),
s6 AS (SELECT source, source_size, CASE WHEN stops THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight * rest AS DOUBLE) / CAST(sharing AS DOUBLE) END AS target FROM s5),
s7 AS (SELECT *, least(CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0::DOUBLE END, 3::DOUBLE) AS ratio FROM s6),
s8 AS (SELECT *, CAST(floor(ratio) AS BIGINT) AS copies, ratio - floor(ratio) AS part FROM s7),
d1 AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.copies,
         CASE WHEN part > 0 AND size > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS q, target - copies * source_size AS wanted
       FROM sized d JOIN s8 t ON d.source IS NOT DISTINCT FROM t.source),
d2 AS (SELECT *, sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d1),
d3 AS (SELECT *, wanted - coalesce(max(CASE WHEN q IS NOT NULL AND upto <= wanted THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM d2),
d4 AS (SELECT *, row_number() OVER (PARTITION BY source, q IS NOT NULL AND upto > wanted AND abs(size - gap) < gap ORDER BY abs(size - gap), q, doc_id) AS place FROM d3)
SELECT doc_id, size, source_size, target,
       size * (copies + CASE WHEN q IS NOT NULL AND (upto <= wanted OR (abs(size - gap) < gap AND place = 1)) THEN 1 ELSE 0 END) AS taken
FROM d4
"""
