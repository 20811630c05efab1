"""Personal data by bootstrapped contextual extraction.

Four fixed expressions find e-mail addresses, IP addresses, card and phone numbers that are written as expected; these are the
seeds.  Looser ones find what may be such a thing in another form: a number without a plus sign or with a wrong check digit, an
address with brackets for its dots, an e-mail address with ``(at)``.  Every mention has the patterns of words that it stands in:
two or three words before, two behind, one on each side.

Patterns and things (values, however often and in whatever form they are written) make a graph.  In each round a pattern's
confidence in a kind is the belief in its things, summed, over their number; confident patterns then lend belief to their
things, which support other patterns in the next round.  Things that reach ``ACCEPT`` are marked wherever they stand.  A value
that is known as a seed is known in its other forms, too.

The graph has a row for each distinct pair of pattern and value, so copies of texts change nothing; all sums are grouped on
Spark with partial aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

KINDS = ("email", "ip", "card", "phone")
#: Rounds over the graph; belief a pattern needs in sum and its least confidence; belief that accepts; things that a pattern is
#: thought to have seen beside its own.
ROUNDS, SUPPORT, CONFIDENT, ACCEPT, UNSEEN = 4, 3.0, 0.6, 0.7, 3
#: Characters of context on each side.
AROUND = 80

# the expressions of the seeds (fixed values); without look-behind they would read long runs again and again
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# looser ones: class, expression, least and most digits
_SIGN, _DOT = r"(?:@|\(at\)|\[at\]|\{at\})", r"(?:\.|\(dot\)|\[dot\]|\{dot\})"
_LOOSE = (
    ("mail", re.compile(rf"(?<![\w.%+-])[\w.%+-]{{1,64}}+(?: ?{_SIGN} ?[\w-]{{1,63}}+(?: ?{_DOT} ?[\w-]{{1,63}}+)*| at [\w-]{{1,63}}+(?: dot [\w-]{{1,63}}+)+)", re.I)),
    ("address", re.compile(r"(?<![\w:.])(?:[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\{\.\}| \. )[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4})(?![\w:])")),
    ("number", re.compile(r"(?<![\w+])[(+]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,18}(?!\w)")),
)
_SOME = re.compile(r"[0-9@]|[(\[{]at[)\]}]| dot ", re.I)
_WORD = re.compile(r"\w+|[^\w\s]|\n")
CLASS = {"email": "mail", "ip": "address", "card": "number", "phone": "number"}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def seeds(line: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the expressions find in a line, by start, then kind."""
    out, last = [], 0
    for m in _DOMAIN.finditer(line):
        before = line[max(line.rfind("@", 0, m.start()) + 1, last) : m.start()]
        local = len(before) - len(before.rstrip(_LOCAL))
        if local:
            last = m.end()
            out.append((m.start() - local, 0, last))
    for m in _IP.finditer(line):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(line):
        if 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(line):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def loose(line: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, str, int]]:
    """(start, class, end) of what may be personal data beside the seeds ``taken``, without overlaps."""
    out, used = [], [(s, e) for s, _, e in taken]
    for name, expression in _LOOSE:
        for m in expression.finditer(line):
            if not any(s < m.end() and m.start() < e for s, e in used):
                out.append((m.start(), name, m.end()))
                used.append(m.span())
    return sorted(out)


def value(name: str, written_as: str) -> str:
    """What a mention of class ``name`` stands for, however it is written."""
    if name == "number":
        return "number:" + _digits(written_as)
    plain = written_as.lower().replace(" at ", "@").replace(" dot ", ".")
    for sign, to in (("at", "@"), ("dot", "."), (".", ".")):
        for a, z in ("()", "[]", "{}"):
            plain = plain.replace(f"{a}{sign}{z}", to)
    return f"{name}:{plain.replace(' ', '')}"


def patterns(text: str, start: int, end: int) -> list[str]:
    """Patterns of words around a mention; digits are zeros, the edge of the text or a line is a word."""
    words = lambda s: [w.lower() if w != "\n" else "^" for w in _WORD.findall(re.sub("[0-9]", "0", s))]
    left = words(("\n" if start <= AROUND else "") + text[max(start - AROUND, 0) : start])[-3:]
    right = words(text[end : end + AROUND] + ("\n" if end + AROUND >= len(text) else ""))[:2]
    out = [f"{' '.join(left[-n:])} _" for n in (2, 3) if len(left) >= n]
    out += [f"_ {' '.join(right)}"] if len(right) == 2 else []
    return out + ([f"{left[-1]} _ {right[0]}"] if left and right else [])


def kinds_of(thing: str) -> list[int]:
    """Kinds that a value of a looser expression may be."""
    name, _, v = thing.partition(":")
    if name == "number":
        return [k for k, (least, most) in ((2, (12, 19)), (3, (7, 15))) if least <= len(v) <= most]
    return [0] if name == "mail" else [1]


def mentions(text: str | None) -> tuple[list[dict], list[dict]]:
    """The seeds and the other mentions of a whole text, line by line (nothing spans two lines)."""
    found, others, at = [], [], 0
    for line in (text or "").split("\n"):
        if _SOME.search(line):
            base = seeds(line)
            for s, k, e in base:
                found.append({"start": at + s, "kind": k, "end": at + e, "thing": value(CLASS[KINDS[k]], line[s:e]), "patterns": patterns(text, at + s, at + e)})
            for s, name, e in loose(line, base):
                thing = value(name, line[s:e])
                if kinds_of(thing):
                    others.append({"start": at + s, "kinds": kinds_of(thing), "end": at + e, "thing": thing, "patterns": patterns(text, at + s, at + e)})
        at += len(line) + 1
    return found, others


_SEED = "start long, kind int, end long, thing string, patterns array<string>".replace(" ", ":").replace(",:", ",")
_OTHER = _SEED.replace("kind:int", "kinds:array<int>")
_SIDES = [pa.field("thing", pa.string()), pa.field("patterns", pa.list_(pa.string()))]
_SCHEMA = [
    pa.field("base", pa.list_(pa.struct([pa.field("start", pa.int64()), pa.field("kind", pa.int32()), pa.field("end", pa.int64()), *_SIDES]))),
    pa.field("others", pa.list_(pa.struct([pa.field("start", pa.int64()), pa.field("kinds", pa.list_(pa.int32())), pa.field("end", pa.int64()), *_SIDES]))),
]


def scanned(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, doc_id, base, others): the mentions of each row of ``docs``, stored; ``row`` tells rows apart."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [mentions(t.as_py()) for t in batch.column("text")]
            columns = [batch.column("doc_id"), *(pa.array(list(x), f.type) for x, f in zip(zip(*both, strict=True) if both else ([], []), _SCHEMA, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field("doc_id"), *_SCHEMA]))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    made = rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base array<struct<{_SEED}>>, others array<struct<{_OTHER}>>")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "pii_mentions")


def discovered(found: DataFrame) -> DataFrame:
    """(thing, kind, belief) of the values beside the seeds that the graph of ``found`` (``scanned``) accepts."""
    seed = found.select(F.explode("base").alias("m")).select("m.thing", "m.kind", "m.patterns", F.lit(None).cast("array<int>").alias("kinds"))
    other = found.select(F.explode("others").alias("m")).select("m.thing", F.lit(None).cast("int").alias("kind"), "m.patterns", "m.kinds")
    said = seed.union(other)
    sure = [F.max((F.col("kind") == k).cast("double")) for k in range(len(KINDS))]
    may = [F.max(F.array_contains("kinds", k)) for k in range(len(KINDS))]
    names = [f"b{k}" for k in range(len(KINDS))]
    things = said.groupBy("thing").agg(*(F.coalesce(x, F.lit(0.0)).alias(b) for x, b in zip(sure, names, strict=True)), *(F.coalesce(x, F.lit(False)).alias(f"may{k}") for k, x in enumerate(may)))
    edges = written(said.select("thing", F.explode("patterns").alias("pattern")).distinct(), "pii_edges")
    now = things = written(things, "pii_things")
    for _ in range(ROUNDS):
        summed = edges.join(now.select("thing", *names), "thing").groupBy("pattern").agg(F.count("*").alias("n"), *(F.sum(b).alias(b) for b in names))
        trust = {b: F.when((F.col(b) >= SUPPORT) & (F.col(b) >= CONFIDENT * (F.col("n") + UNSEEN)), F.least(F.col(b) / (F.col("n") + UNSEEN), F.lit(0.99))).otherwise(0.0) for b in names}
        trusted = summed.select("pattern", *(x.alias(b) for b, x in trust.items())).filter(F.greatest(*names) > 0)
        lent = edges.join(trusted, "pattern").groupBy("thing").agg(*((1 - F.exp(F.sum(F.log(1 - F.col(b))))).alias(f"to_{b}") for b in names))
        new = {b: F.greatest(F.col(b), F.when(F.col(f"may{k}"), F.coalesce(f"to_{b}", F.lit(0.0))).otherwise(0.0)) for k, b in enumerate(names)}
        now = written(things.join(lent, "thing", "left").select("thing", *(x.alias(b) for b, x in new.items()), *(f"may{k}" for k in range(len(KINDS)))), "pii_beliefs")
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(b).alias("belief"), F.col(f"may{k}").alias("may")) for k, b in enumerate(names)))).alias("x")
    return now.select("thing", kinds).filter(F.col("x.may") & (F.col("x.belief") >= ACCEPT)).select("thing", "x.kind", "x.belief")


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """For each row of ``docs``: ``doc_id``, ``base`` and ``spans``, arrays of (start, kind, end) in code points, ends exclusive, by
    start and kind (a number, see ``KINDS``): the seeds, and these with what was discovered.

    Null and empty texts have none.  Repeated rows, null ids and equal ids stay rows of their own.  Of two kinds that a value
    may be the one with the greater belief is taken, of equals the first.  An empty table gives an empty result."""
    found = scanned(docs, text, doc_id)
    new = discovered(found).groupBy("thing").agg(F.min(F.struct((-F.col("belief")).alias("least"), "kind")).alias("x")).select("thing", "x.kind")
    places = found.select("row", F.explode("others").alias("m")).select("row", "m.thing", "m.start", "m.end")
    added = places.join(new, "thing").groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    plain = F.transform("base", lambda m: F.struct(m.start.alias("start"), m.kind.alias("kind"), m.end.alias("end")))
    out = found.select("row", "doc_id", plain.alias("base")).join(added, "row", "left")
    return out.select("doc_id", "base", F.array_sort(F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))).alias("spans"))
