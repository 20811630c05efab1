"""Repair of the structure of conversations by secondary-sorted streaming.

Turns are dealt by conversation and sorted by turn, and one pass over Arrow batches carries a small dynamic programme from row
to row: for each state of the grammar ``(s?(ua)+)?`` (nothing yet, after a system turn, after a user turn, after an assistant
turn) the cheapest edits that lead there.  Costs are kept relative to the cheapest and of equal costs only the order of the
edit strings is kept, so a state of the programme is one of a few tuples, and a step is a look-up.

What must be remembered to go back is one number of 20 bits for each row.  A conversation of up to ``HELD_ROWS`` rows and
``HELD_BYTES`` of text is finished at once.  A longer one is spilled: its rows and back pointers leave the stream in blocks of
that size, which Spark writes to the shared folder, and a second stream reads the blocks of such conversations from the last
to the first, carrying one state.  Neither stream ever holds more than a block.

Costs: keep 0, give the role user or assistant 1, delete 2 (the only choice for blank and repeated rows), insert an empty turn
of the user or the assistant 5; a truncated row that stays costs 5 more.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

#: Rows and bytes of text of a conversation that are held at once.
HELD_ROWS, HELD_BYTES = 1 << 16, 8 << 20
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE, ENDS = " \t\n\v\f\r", (".", "!", "?")
#: States: nothing yet, after a system, a user, an assistant turn.  A user turn may follow all but ``USER``.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
LETTERS = ("", "D", "K", "R", "IK", "IR")
START = ((0, None, None, None), (0, None, None, None))


def _moves(initial: str, dead: bool, cut: bool) -> Iterator[tuple[int, int, int, str]]:
    """(from, to, cost, letters) of every way to take a row."""
    for x in range(4):
        yield x, x, DELETE, "D"
    if dead:
        return
    more = TRUNCATED if cut else 0
    if initial == "s":
        yield NOTHING, SYSTEM, more, "K"
    for x in range(4):
        for letters, paid in (("", 0), ("I", INSERT)):
            said = ASSISTANT if (x == USER) == (letters == "") else USER
            yield x, said, paid + more + REROLE, letters + "R"
            if initial == ("u" if said == USER else "a"):
                yield x, said, paid + more, letters + "K"


@lru_cache(1 << 14)
def step(state: tuple, initial: str, dead: bool, cut: bool) -> tuple[tuple, int, int]:
    """(next state, what it costs, back pointers) for a row; a state has relative costs and ranks of edit strings.

    Edit strings of different states after the same row differ before either ends, so the order of two longer ones is that
    of the strings they grew from and, for one string, of the letters added."""
    costs, ranks = state
    best: list = [None] * 4
    for x, to, paid, letters in _moves(initial, dead, cut):
        if costs[x] is not None:
            way = (costs[x] + paid, ranks[x], letters, x)
            best[to] = way if best[to] is None else min(best[to], way)
    least = min(w[0] for w in best if w)
    order = sorted(w[1:3] for w in best if w)
    after = tuple(None if w is None else w[0] - least for w in best), tuple(None if w is None else order.index(w[1:3]) for w in best)
    back = sum((LETTERS.index(w[2]) * 4 + w[3]) << (5 * to) for to, w in enumerate(best) if w)
    return after, least, back


def finish(state: tuple) -> tuple[int, int, str]:
    """(cost, state, last insertions) of the cheapest end."""
    ends = ((NOTHING, 0, ""), (ASSISTANT, 0, ""), (USER, INSERT, "I"), (SYSTEM, 2 * INSERT, "II"))
    cost, _, tail, x = min((state[0][x] + paid, state[1][x], tail, x) for x, paid, tail in ends if state[0][x] is not None)
    return cost, x, tail


def traced(back: array, end: int) -> tuple[int, list[str]]:
    """(state before, letters of each row) of rows with these back pointers that end in ``end``."""
    letters = []
    for b in reversed(back):
        code = (b >> (5 * end)) & 31
        letters.append(LETTERS[code >> 2])
        end = code & 3
    return end, letters[::-1]


def edited(state: int, letters: list[str], roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The turns (role, text) that edits make of rows."""
    out = []
    for todo, role, text in zip(letters, roles, texts, strict=True):
        for c in todo:
            if c == "D":
                continue
            if c == "K" and state == NOTHING and role[:1] == "s":
                state = SYSTEM
                out.append((role, text))
                continue
            state = ASSISTANT if state == USER else USER
            name = "user" if state == USER else "assistant"
            out.append((role, text) if c == "K" else (name, text if c == "R" else ""))
    return out


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    """What the stream carries of a conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.block, self.state = conv_id, 0, START
        self.counts, self.cost, self.before = dict.fromkeys(_COUNTS, 0), 0, None
        self.least = self.most = None
        self.turns = 0
        self.clear()

    def clear(self) -> None:
        self.back, self.roles, self.texts, self.bytes = array("I"), [], [], 0

    def add(self, turn, role: str, text: str, late: bool) -> None:
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        bare = text.rstrip(SPACE)
        blank, cut = not bare, not bare.endswith(ENDS)
        duplicate = not blank and (late or self.before == (turn, role, text))
        cut = cut and not blank and not duplicate
        self.counts["blank"] += blank
        self.counts["duplicate"] += duplicate
        self.counts["truncated"] += cut
        self.counts["illegal"] += self.before is not None and self.before[1][:1] + role[:1] not in ("su", "ua", "au")
        self.before = (turn, role, text)
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        self.state, paid, back = step(self.state, initial, blank or duplicate, cut)
        self.cost += paid
        self.back.append(back)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(role) + len(text)

    def row(self, end: tuple | None = None) -> dict:
        """The rows held, as a block of the result: finished if they are the whole conversation, else with back pointers."""
        out = dict.fromkeys(_ROW.names) | {"conv_id": self.conv_id, "block": self.block, "finished": end is not None and self.block == 0}
        if end is not None:
            cost, state, tail = end
            gaps = self.most - self.least + 1 - self.turns if self.turns else 0
            out |= self.counts | {"gaps": gaps, "cost": self.cost + cost, "state": state, "tail": tail}
        if out["finished"]:
            out |= _made(self.back, out["state"], out["tail"], self.roles, self.texts)[1]
        else:
            out |= {"back": zlib.compress(self.back.tobytes(), 1), "turns": list(zip(self.roles, self.texts, strict=True))}
        return out | {"turns": [{"role": r, "text": t} for r, t in out["turns"]]}


def _made(back: array, end: int, tail: str, roles: list[str], texts: list[str]) -> tuple[int, dict]:
    """(state before, columns) of rows whose edits end in ``end`` and are followed by the insertions ``tail``."""
    state, letters = traced(back, end)
    if tail:
        letters, roles, texts = [*letters, tail], [*roles, ""], [*texts, ""]
    return state, {"audit": "".join(letters), "turns": edited(state, letters, roles, texts)}


_ROW = pa.schema([("block", pa.int32()), ("finished", pa.bool_()), *((c, pa.int64()) for c in _COUNTS), ("state", pa.int32()), ("tail", pa.string()), ("back", pa.binary()), ("audit", pa.string()), ("turns", _TURNS)])
_DDL = ", ".join(["block int, finished boolean", *(f"{c} long" for c in _COUNTS), "state int, tail string, back binary, audit string, turns array<struct<role:string,text:string>>"])


class _Out:
    """Rows gathered to batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int):
        self.schema, self.most, self.rows, self.size = schema, most, [], 0

    def add(self, row: dict, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if self.size >= self.most or len(self.rows) >= 4096:
            yield self.taken()

    def taken(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist(self.rows, self.schema)
        self.rows, self.size = [], 0
        return out


def repair(turns: DataFrame, held_rows: int = HELD_ROWS, held_bytes: int = HELD_BYTES, gone: str | None = None) -> DataFrame:
    """The repaired conversations of ``turns`` (conv_id, turn, role, text; more columns, whatever their names, are left alone):
    ``conv_id``, ``block``, ``audit`` (letters of the edits, K R D I), ``turns`` (array of role and text) and, in a
    conversation's last block, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal`` and ``cost``, else null.

    A conversation is one row (``finished``) unless it is larger than a block.  Rows are in order of turn (null first), then
    role, then text; null roles and texts are empty, rows with a null ``conv_id`` are one conversation.  Of repeated rows the
    first stays.  A row whose column ``gone`` (a name, if given) is true counts for nothing, but its conversation is in the result: with zeros and no turns if
    nothing else is left.  An empty table gives an empty result.  Of edits with equal costs the ASCII-least string is taken."""
    left_out = F.coalesce(gone, F.lit(False)) if gone else F.lit(False)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), left_out.alias("gone"))
    rows = rows.withColumns({"h1": F.xxhash64("conv_id", "role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role", "conv_id"), "at": F.struct(F.col("turn").isNotNull(), "turn")})
    # what stands at several turns; equal rows of one turn are neighbours in the stream
    again = rows.filter("not gone").groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last").drop("last")
    late = F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    marked = rows.join(again, ["h1", "h2"], "left").select("conv_id", "turn", "role", F.when(~F.col("gone"), F.col("text")).alias("text"), late.alias("late"))
    conv_type = turns.schema["conv_id"].dataType.simpleString()

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, None
        for batch in batches:
            out = out or _Out(pa.schema([batch.schema.field("conv_id"), *_ROW]), held_bytes)
            for conv_id, turn, role, text, late_ in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "late")), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        yield from out.add(now.row(finish(now.state)), now.bytes)
                    now = _Conversation(conv_id)
                if text is None:
                    continue
                if len(now.back) >= held_rows or now.bytes >= held_bytes:
                    yield from out.add(now.row(), now.bytes)
                    now.block += 1
                    now.clear()
                now.add(turn, role, text, late_)
        if now is not None:
            yield from out.add(now.row(finish(now.state)), now.bytes)
            yield out.taken()

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["tail"] is not None:
                    end = row["state"]
                back = array("I")
                back.frombytes(zlib.decompress(row["back"]))
                end, made = _made(back, end, row["tail"] or "", [t["role"] for t in row["turns"]], [t["text"] for t in row["turns"]])
                made["turns"] = [{"role": r, "text": t} for r, t in made["turns"]]
                yield pa.RecordBatch.from_pylist([row | made | {"back": None}], batch.schema)

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    blocks = written(marked.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(forward, f"conv_id {conv_type}, {_DDL}"), "repair_blocks")
    spilled = blocks.filter("not finished").repartition("conv_id").sortWithinPartitions("conv_id", F.col("block").desc())
    done = blocks.filter("finished").unionByName(spilled.mapInArrow(backward, blocks.schema))
    return done.drop("state", "tail", "back")


def digests(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of ``repaired``: ``conv_id``, the counts, ``audit`` and ``repaired_sha256``, the digest of the
    turns as ``role:text``, joined by newlines.  A conversation in several blocks is hashed block by block, in order."""
    line = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    once = repaired.filter("finished").select("conv_id", *_COUNTS, "audit", F.sha2(line, 256).alias("repaired_sha256"))
    lines = repaired.filter("not finished").select("conv_id", "block", *_COUNTS, "audit", F.size("turns").alias("n"), line.alias("lines"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, audit, begun = hashlib.sha256(), [], False
        for batch in batches:
            for row in batch.to_pylist():
                if row["n"]:
                    digest.update(("\n" * begun + row["lines"]).encode())
                    begun = True
                audit.append(row["audit"])
                if row["cost"] is not None:  # the last block
                    made = {k: row[k] for k in ("conv_id", *_COUNTS)} | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
                    yield pa.RecordBatch.from_pylist([made], pa.schema([batch.schema.field("conv_id"), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]))
                    digest, audit, begun = hashlib.sha256(), [], False

    parts = lines.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(hashed, once.schema)
    return once.unionByName(parts)


#: CRC-32 of a text of ASCII characters, bit by bit.
CRC32 = "xor(list_reduce([4294967295::BIGINT] || flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for c in string_split({}, '')]), lambda h, b: xor(xor(h, b) >> 1, CASE WHEN xor(h, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"


def _ways(*ways: tuple[str, str, str, str]) -> str:
    """The cheapest, then ASCII-least of the ways (state, cost, letters, condition) in SQL."""
    each = ", ".join(f"CASE WHEN {x} IS NOT NULL AND ({when}) THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letters}'}} END" for x, cost, letters, when in ways)
    return f"list_sort(list_filter([{each}], lambda x: x IS NOT NULL))[1]"


_SAYS = {u: [(x, f"{paid} + t{more}", letters, when) for x, paid, ins in moves for letters, more, when in ((f"{ins}K", "", f"ok AND r = '{u}'"), (f"{ins}R", " + 1", "ok"))] for u, moves in (("u", (("s0", 0, ""), ("s1", 0, ""), ("s3", 0, ""), ("s2", 5, "I"))), ("a", (("s2", 0, ""), ("s0", 5, "I"), ("s1", 5, "I"), ("s3", 5, "I"))))}

SQL = f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
rows_ AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM src WHERE k <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM rows_),
faults AS (SELECT *, NOT blank AND nth > 1 AS duplicate, NOT blank AND nth = 1 AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') AS truncated, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM numbered)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank, count_if(duplicate)::BIGINT AS duplicate, count_if(truncated)::BIGINT AS truncated, count_if(pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(i) AS n FROM faults GROUP BY conv_id),
dp AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': ''}} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR) AS s1, NULL::STRUCT(c INTEGER, a VARCHAR) AS s2, NULL::STRUCT(c INTEGER, a VARCHAR) AS s3 FROM counts
  UNION ALL SELECT conv_id, i, {_ways(("s0", "2", "D", "true"))}, {_ways(("s1", "2", "D", "true"), ("s0", "t", "K", "ok AND r = 's'"))}, {_ways(("s2", "2", "D", "true"), *_SAYS["u"])}, {_ways(("s3", "2", "D", "true"), *_SAYS["a"])}
  FROM (SELECT d.conv_id, f.i, s0, s1, s2, s3, r, NOT (f.blank OR f.duplicate) AS ok, CASE WHEN f.truncated THEN 5 ELSE 0 END AS t FROM dp d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1)),
ended AS (SELECT d.conv_id, {_ways(("s0", "0", "", "true"), ("s3", "0", "", "true"), ("s2", "5", "I", "true"), ("s1", "10", "II", "true"))} AS best FROM dp d JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.n = d.i),
letters AS (SELECT conv_id, unnest(string_split(best.a, '')) AS e, unnest(range(len(best.a))) AS place FROM ended WHERE best.a <> ''),
placed AS (SELECT *, count_if(e <> 'I') OVER w AS i, count_if(e <> 'D') OVER w AS o FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
held AS (SELECT p.*, f.role, f.text, max(CASE WHEN p.o = 1 AND e = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS s FROM placed p LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND p.e <> 'I' WHERE e <> 'D'),
made AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place) AS t FROM held GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.best.c, 0)::BIGINT AS cost, coalesce(e.best.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN made m ON m.conv_id IS NOT DISTINCT FROM a.conv_id
"""
