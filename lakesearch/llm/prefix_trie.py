"""A trie of conversations over whole turns, kept compacted and found through hashed handles (a z-fast trie).

A prefix of a conversation is known by its depth and two 64-bit hashes, each the exclusive or of hashes of (depth, turn), so the
hashes of all prefixes are a running aggregate, also of a conversation that many tasks share.  The trie's nodes are compacted:
a node's label has the hashes of the depths on its edge, from its parent's extent (left out) to its own (included).  Its
handle is the prefix at the 2-fattest depth of that range, the one divisible by the highest power of two.

A batch of conversations is inserted in three steps.  (1) Fat binary search: each conversation probes, step by step, the handle
at the 2-fattest depth of the range that is left; a handle that is there moves the lower bound to its node's extent, another
one the upper bound, so the exit node is found after about log2(turns) hash joins, all conversations at once.  One more
look-up, by the first turn below the last extent, gives the edge, and comparing its label with the conversation's own hashes
gives the depth where it leaves.  (2) Of conversations that leave at the same place with the same next turn one, picked by
hash, becomes a new path; the others leave that path further down and are compared with its label.  This goes on until none
waits, about log2(conversations) rounds for any input, because picking by hash is picking at random.  (3) Paths and old edges
are cut where conversations left or ended.

Long conversations are cut into pages of ``PAGE`` turns.  A page is a string of its own, in the trie that hangs on the prefix
before it, so rows stay small and pages are inserted side by side; depths and hashes are those of the whole conversation, so
the tries join up by themselves.  Equal strings are one string.

Sums over subtrees are taken over compacted nodes by pointer doubling (log2(height) rounds), and edges are expanded to one
row for each depth at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written

#: Turns on a page, a power of two; strings of the first batch, one of so many.
PAGE, FIRST = 1024, 8
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, segment, place, t1, t2, chars) of ``turns`` (conv_id, turn, role, text): places from 1 in order of turn (null
    first), role and text, two hashes of role and text, and code points of the text; null roles and texts are empty, rows
    with a null ``conv_id`` are left out.

    Turns are dealt by ranges, so a conversation of any length is spread over tasks; its rows in one task are a segment."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", text("role"), text("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    hashes = F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "text", "role").alias("t2"), F.length("text").cast("long").alias("chars")
    # ids of neighbouring rows of a partition follow each other; once written they stay
    stored = written(dealt.select("conv_id", *hashes, F.monotonically_increasing_id().alias("n")), "trie_turns").withColumn("segment", F.shiftright("n", 33))
    parts = stored.groupBy("conv_id", "segment").agg(F.min("n").alias("first"), F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("conv_id").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = stored.join(parts.select("conv_id", "segment", (F.col("first") - before - 1).alias("zero")), ["conv_id", "segment"])
    return placed.select("conv_id", "segment", (F.col("n") - F.col("zero")).alias("place"), "t1", "t2", "chars")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, h1, h2, chars, last) of each prefix: its hashes, its code points and whether it is the whole
    conversation; ``turns`` has (conv_id, segment, depth, t1, t2, chars, length), depths of a segment following each other."""
    own = turns.withColumns({"h1": F.xxhash64("depth", "t1"), "h2": F.xxhash64("t2", "depth")})
    run = W.partitionBy("conv_id", "segment").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    inside = own.select("conv_id", "segment", "depth", F.bit_xor("h1").over(run).alias("h1"), F.bit_xor("h2").over(run).alias("h2"), F.sum("chars").over(run).alias("chars"), (F.col("depth") == F.col("length")).alias("last"))
    whole = own.groupBy("conv_id", "segment").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.sum("chars").alias("more"))
    past = W.partitionBy("conv_id").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    before = whole.select("conv_id", "segment", zero(F.bit_xor("x1").over(past)).alias("x1"), zero(F.bit_xor("x2").over(past)).alias("x2"), zero(F.sum("more").over(past)).alias("more"))
    joined = inside.join(before, ["conv_id", "segment"])
    return joined.select("conv_id", "depth", F.col("h1").bitwiseXOR(F.col("x1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("x2")).alias("h2"), (F.col("chars") + F.col("more")).alias("chars"), "last")


def _at(points: str | Column, depth: Column) -> Column:
    """The entry of ``points`` (depth, h1, h2, chars; one for each depth from the first) at ``depth``, null beyond it."""
    points = F.col(points) if isinstance(points, str) else points
    return F.get(points, (depth - F.get(points, F.lit(0)).depth).cast("int"))


def _key(point: Column) -> Column:
    return F.struct(point.depth.alias("depth"), point.h1.alias("h1"), point.h2.alias("h2"))


def _end(points: str) -> Column:
    return F.element_at(points, -1)


def _agree(points: str, label: str) -> Column:
    """How many entries of ``label`` after the first are those of ``points``, too; the first ones are the same prefix."""
    same = F.filter(label, lambda x: F.coalesce((_at(points, x.depth).h1 == x.h1) & (_at(points, x.depth).h2 == x.h2), F.lit(False)))
    return F.size(same) - 1


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides; null if there is none."""
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(low.bitwiseXOR(high))) - 1)
    return F.when(low < high, high - high % step)


def strings(prefix: DataFrame, page: int = PAGE) -> DataFrame:
    """(conv_id, page, points): the distinct pages of all conversations, each with the smallest conversation that has it and
    its points (depth, h1, h2, chars), from the prefix before the page (left out of it) to its end."""
    number = F.expr(f"(depth - 1) div {page}")
    ends = prefix.filter(F.col("last") | (F.col("depth") % page == 0)).groupBy("depth", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    chosen = ends.select("conv_id", number.alias("page"))
    pages = F.when(F.col("depth") % page == 0, F.array(number, number + 1)).otherwise(F.array(number))
    rows = prefix.select("conv_id", F.explode(pages).alias("page"), F.struct("depth", "h1", "h2", "chars").alias("point")).join(chosen, ["conv_id", "page"], "left_semi")
    made = rows.groupBy("conv_id", "page").agg(F.array_sort(F.collect_list("point")).alias("points"))
    zero = F.lit(0).cast("long")
    origin = F.array(F.struct(zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), zero.alias("chars")))
    # an origin alone is a conversation that ends with the page before
    whole = made.select("conv_id", "page", F.when(F.col("page") == 0, F.concat(origin, "points")).otherwise(F.col("points")).alias("points"))
    return whole.filter(F.size("points") > 1)


def _spread(key: Column, *ids: str) -> Column:
    """``key``, or one that is nowhere in place of null, another for each row."""
    away = F.struct((-1 - F.pmod(F.xxhash64(*ids), F.lit(1 << 20))).alias("depth"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
    return F.when(key.depth.isNotNull(), key).otherwise(away)


def locate(batch: DataFrame, nodes: DataFrame) -> DataFrame:
    """``batch`` (conv_id, page, points) with the depth ``left`` where each string leaves the trie and ``of_conv`` and
    ``of_page``, the path with that edge (null where it leaves at a node without such a turn or ends at the extent)."""
    longest = batch.agg(F.max(F.size("points"))).first()[0] or 1
    handles = nodes.select(F.col("handle").alias("probe"), F.get("label", F.lit(0)).depth.alias("above"), _key(_end("label")).alias("extent"))
    now = batch.withColumns({"low": F.get("points", F.lit(0)).depth, "high": _end("points").depth})
    for _ in range(int(longest).bit_length() + 1):
        at = fattest(F.col("low"), F.col("high"))
        probing = now.withColumn("at", at).withColumn("probe", _spread(_key(_at("points", F.col("at"))), "conv_id", "page"))
        met = probing.join(handles, "probe", "left")
        there, hit = F.col("extent").isNotNull(), F.coalesce(_key(_at("points", F.col("extent.depth"))) == F.col("extent"), F.lit(False))
        now = met.select(
            *batch.columns,
            F.when(hit, F.col("extent.depth")).when(there, F.col("above")).otherwise(F.col("low")).alias("low"),
            F.when(there & ~hit, F.col("above")).when(~there & F.col("at").isNotNull(), F.col("at") - 1).otherwise(F.col("high")).alias("high"),
        )
    edges = nodes.select(F.col("opening").alias("probe"), F.col("conv_id").alias("of_conv"), F.col("page").alias("of_page"), "label")
    below = now.withColumn("probe", _spread(_key(_at("points", F.col("low") + 1)), "conv_id", "page")).join(edges, "probe", "left")
    return below.select(*batch.columns, (F.col("low") + F.coalesce(F.when(F.col("label").isNotNull(), _agree("points", "label")), F.lit(0))).alias("left"), "of_conv", "of_page")


def _nodes(pieces: DataFrame, cuts: DataFrame) -> DataFrame:
    """Nodes (conv_id, page, label, handle, opening) from ``pieces`` of paths, cut at the depths ``cuts`` (conv_id, page,
    depth)."""
    known = cuts.distinct().groupBy("conv_id", "page").agg(F.array_sort(F.collect_list("depth")).alias("cuts"))  # a page's depths at most
    first, last = F.get("label", F.lit(0)).depth, _end("label").depth
    inner = F.filter(F.coalesce("cuts", F.array().cast("array<bigint>")), lambda k: (k > first) & (k < last))
    stops = F.concat(F.array(first), inner, F.array(last))
    both = F.transform(F.sequence(F.lit(1), F.size("stops") - 1), lambda i: F.struct(F.get("stops", i - 1).alias("a"), F.get("stops", i).alias("b")))
    cut = pieces.select("conv_id", "page", "label").join(known, ["conv_id", "page"], "left").withColumn("stops", stops).withColumn("part", F.explode(both))
    part = cut.select("conv_id", "page", F.slice("label", (F.col("part.a") - first + 1).cast("int"), (F.col("part.b") - F.col("part.a") + 1).cast("int")).alias("label"))
    first, last = F.get("label", F.lit(0)).depth, _end("label").depth
    return part.select("conv_id", "page", "label", _key(_at("label", fattest(first, last))).alias("handle"), _key(F.get("label", F.lit(1))).alias("opening"))


def insert(nodes: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The nodes of the trie of ``nodes`` and the strings of ``batch``."""
    none = F.lit(None).cast("long")
    if nodes is None:
        found = batch.select("*", F.get("points", F.lit(0)).depth.alias("left"), none.alias("of_conv"), none.alias("of_page"))
    else:
        found = written(locate(batch, nodes), "trie_located")
    pieces, cuts = [] if nodes is None else [nodes.select("conv_id", "page", "label")], []
    while not found.isEmpty():
        cuts.append(found.filter("of_conv is not null").select(F.col("of_conv").alias("conv_id"), F.col("of_page").alias("page"), F.col("left").alias("depth")))
        waiting = found.filter(F.col("left") < _end("points").depth).select("conv_id", "page", "points", "left").withColumn("next", _key(_at("points", F.col("left") + 1)))
        rest = F.slice("points", (F.col("left") - F.get("points", F.lit(0)).depth + 1).cast("int"), F.size("points"))
        first = F.min(F.struct(F.xxhash64("conv_id", "page").alias("draw"), "conv_id", "page", rest.alias("label"))).alias("w")
        paths = written(waiting.groupBy("next").agg(first).select("next", "w.conv_id", "w.page", "w.label"), "trie_paths")
        pieces.append(paths.select("conv_id", "page", "label"))
        on = paths.select("next", F.col("conv_id").alias("of_conv"), F.col("page").alias("of_page"), "label")
        others = waiting.join(on, "next").filter((F.col("conv_id") != F.col("of_conv")) | (F.col("page") != F.col("of_page")))
        found = written(others.select("conv_id", "page", "points", (F.col("left") + _agree("points", "label")).alias("left"), "of_conv", "of_page"), "trie_waiting")
    if not cuts:
        return nodes
    return written(_nodes(reduce(DataFrame.unionByName, pieces), reduce(DataFrame.unionByName, cuts)), "trie_nodes")


def build(pages: DataFrame, first: int = FIRST) -> DataFrame | None:
    """The nodes of the trie of ``pages`` (``strings``), inserted in two batches; ``None`` without any."""
    early = F.pmod(F.xxhash64("page", "conv_id"), F.lit(first)) == 0
    nodes = None
    for batch in (pages.filter(early), pages.filter(~early)):
        if not batch.isEmpty():
            nodes = insert(nodes, batch)
    return nodes


def _id_lists(ends: DataFrame) -> DataFrame:
    """(id, digest) for the conversations of each id in ``ends`` (id, conv_id): of their ids in order, joined by commas.

    Ids are sorted by Spark and hashed one by one as they stream by, so a group of any size takes no room."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, schema = None, None, None
        for batch in batches:
            out = []
            schema = pa.schema([batch.schema.field(c) for c in ("depth", "h1", "h2")] + [("digest", pa.string())])
            for row in zip(*(batch.column(c).to_pylist() for c in ("depth", "h1", "h2", "conv_id")), strict=True):
                if row[:3] != now:
                    if now is not None:
                        out.append(dict(zip(("depth", "h1", "h2"), now, strict=True)) | {"digest": digest.hexdigest()})
                    now, digest = row[:3], hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(str(row[3]).encode())
            yield pa.RecordBatch.from_pylist(out, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "h1", "h2"), now, strict=True)) | {"digest": digest.hexdigest()}], schema)

    flat = ends.select("id.depth", "id.h1", "id.h2", "conv_id").repartition("depth", "h1", "h2").sortWithinPartitions("depth", "h1", "h2", "conv_id")
    return flat.mapInArrow(hashed, "depth long, h1 long, h2 long, digest string").select(F.struct("depth", "h1", "h2").alias("id"), "digest")


def _subtrees(nodes: DataFrame) -> DataFrame:
    """``nodes`` (id, up: the parent's id or null, and n, weight, edges, leaves, conv_id) with sums, and the least ``conv_id``,
    over each node's subtree, by pointer doubling: after round k a node has the sums of all nodes less than 2^k below it and
    points to its 2^k-th ancestor."""
    now = nodes
    while not now.filter("up is not null").isEmpty():
        sent = now.filter("up is not null").groupBy(F.col("up").alias("id")).agg(*(F.sum(c).alias(f"{c}_") for c in ("n", "weight", "edges", "leaves")), F.min("conv_id").alias("conv_id_"))
        more = now.join(sent, "id", "left")
        added = {c: F.col(c) + F.coalesce(f"{c}_", F.lit(0)) for c in ("n", "weight", "edges", "leaves")}
        summed = more.select("id", "up", *(v.alias(c) for c, v in added.items()), F.least("conv_id", "conv_id_").alias("conv_id"))
        # nothing is above a root
        above = now.filter("up is not null").select(F.col("id").alias("up"), F.col("up").alias("up_"))
        now = written(summed.join(above, "up", "left").select("id", F.col("up_").alias("up"), "n", "weight", "edges", "leaves", "conv_id"), "trie_sums")
    return now


def trie(turns: DataFrame, turnless: DataFrame, page: int = PAGE) -> DataFrame:
    """One row for each distinct prefix of the conversations of ``turns`` (see ``prefixes``), the empty one included:
    ``conv_id``, the smallest conversation that begins with it, ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``turnless`` (conv_id) are conversations without a turn: they begin with the root only.  Copies count as often as they are
    there.  Without any conversation the result is empty."""
    prefix = written(prefixes(turns), "trie_prefixes")
    pages = written(strings(prefix, page), "trie_strings")
    nodes = build(pages)
    zero = F.lit(0).cast("long")
    root = F.struct(zero.alias("depth"), zero.alias("h1"), zero.alias("h2"))
    ends = prefix.filter("last").select(F.struct("depth", "h1", "h2").alias("id"), "conv_id", "chars").union(turnless.select(root, "conv_id", zero))
    groups = ends.groupBy("id").agg(F.count("*").alias("m"), F.min("conv_id").alias("least"), F.min("chars").alias("at"))
    lists = _id_lists(ends.select("id", "conv_id").join(groups.filter("m > 1").select("id"), "id", "left_semi"))
    ended = groups.join(lists, "id", "left").select("id", "m", "least", F.coalesce("digest", F.sha2(F.col("least").cast("string"), 256)).alias("digest"))
    label_type = pages.schema["points"].dataType.simpleString()
    compact = turns.sparkSession.createDataFrame([], f"label {label_type}") if nodes is None else nodes.select("label")
    origin = ends.limit(1).select(F.array(F.struct(zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), zero.alias("chars"))).cast(label_type).alias("label"))
    all_nodes = compact.union(origin).select("label", _key(_end("label")).alias("id"), F.when(F.size("label") > 1, _key(F.get("label", F.lit(0)))).alias("parent"))
    kids = all_nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    told = written(all_nodes.join(ended, "id", "left").join(kids, "id", "left"), "trie_told")
    chars, above = _end("label").chars, F.get("label", F.lit(0)).chars
    m = F.coalesce("m", zero)
    sums = _subtrees(told.select("id", F.col("parent").alias("up"), m.alias("n"), (m * chars).alias("weight"), (chars - above).alias("edges"), F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("leaves"), F.col("least").alias("conv_id")))
    full = told.select("id", "parent", "label", "kids", "digest").join(sums.drop("up"), "id").join(sums.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    steps = F.when(F.size("label") > 1, F.sequence(F.lit(1), F.size("label") - 1)).otherwise(F.array(F.lit(0)))
    each = full.withColumn("i", F.explode(steps)).withColumns({"lowest": F.col("i") == F.size("label") - 1, "before": F.get("label", F.greatest(F.col("i") - 1, F.lit(0))).chars})
    below = F.col("edges") - (chars - above) + chars - F.col("before")
    return each.select(
        "conv_id", F.get("label", F.col("i")).depth.alias("depth"), F.when(F.col("i") <= 1, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(F.col("lowest"), F.coalesce("kids", zero)).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("weight") - F.col("n") * F.col("before") - below).alias("saved_tokens"), F.when(F.col("lowest"), F.coalesce("digest", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame, heads: int = 6, group: int = 100) -> tuple[DataFrame, DataFrame]:
    """(turns for ``trie``, conversations without any) after each conversation's first turns, as many as a hash of its id modulo
    ``heads`` says, were replaced by those of the first conversation of its hundred (``group``)."""
    own = numbered(turns)
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("size"))
    known = sizes.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads, "base": F.col("conv_id") - F.col("conv_id") % group})
    known = known.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left").withColumn("given", F.least("h", F.coalesce("base_size", F.lit(0).cast("long"))))
    known = known.select("conv_id", "base", "h", "given", (F.col("given") + F.greatest(F.col("size") - F.col("h"), F.lit(0).cast("long"))).alias("length"))
    first = own.filter(F.col("place") < heads).select(F.col("conv_id").alias("base"), "place", "t1", "t2", "chars")
    head = known.join(first, "base").filter("place <= given").select("conv_id", F.lit(-1).cast("long").alias("segment"), F.col("place").alias("depth"), "t1", "t2", "chars", "length")
    tail = own.join(known, "conv_id").filter("place > h").select("conv_id", "segment", (F.col("given") + F.col("place") - F.col("h")).alias("depth"), "t1", "t2", "chars", "length")
    return head.union(tail), known.filter("length = 0").select("conv_id")


from .structure_repair import CRC32  # noqa: E402  the same digest in SQL

SQL = f"""
WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS size FROM own GROUP BY conv_id),
known AS (SELECT s.conv_id, s.h, s.base, least(s.h, coalesce(b.size, 0)) AS given FROM (SELECT *, {CRC32.format("conv_id::VARCHAR")} % 6 AS h, conv_id - conv_id % 100 AS base FROM sizes) s LEFT JOIN sizes b ON b.conv_id = s.base),
turns AS (SELECT k.conv_id, o.place AS depth, role, text FROM known k JOIN own o ON o.conv_id = k.base WHERE o.place <= k.given
  UNION ALL SELECT k.conv_id, k.given + o.place - k.h, role, text FROM known k JOIN own o ON o.conv_id = k.conv_id WHERE o.place > k.h),
keyed AS (SELECT conv_id, depth, length(text) AS chars, md5(string_agg(md5(role) || md5(text), '' ) OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM turns UNION ALL SELECT conv_id, 0, 0, '' FROM known),
rows_ AS (SELECT *, lag(key) OVER w AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM keyed WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (SELECT depth, key, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (last) AS ends FROM rows_ GROUP BY depth, key),
kids AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
own_ AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.key = n.key),
sums AS (SELECT r.depth, r.key, count_if(n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved FROM own_ n JOIN rows_ r ON r.conv_id = n.conv_id AND r.depth <= n.depth GROUP BY r.depth, r.key)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM own_ n JOIN sums s ON s.depth = n.depth AND s.key = n.key LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.up
"""
