"""Chat formatting from event logs, in DataFrame functions only.

A log has one row for each event of a message: a delta appends text, an edit or a regeneration replaces what came before.
A message's events are put in the order of their sequence numbers; folding them gives the final messages, of which
conversations are made, rendered with a template that marks turns.  Control strings inside texts are escaped with a backslash after
their first character, and backslashes are doubled, so every text can be read back unchanged.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Strings that mean something to this or other chat templates and never stand unescaped in a text (fixed values).
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: Kinds of events that replace a message's text so far; all others append.
REPLACING = ("edit", "regenerate")


def escape(text: Column) -> Column:
    """Escaped text: it holds none of ``CONTROL``, and ``unescape`` gives the text back."""
    tails = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), tails, "\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def _header(role: Column) -> Column:
    return F.concat(F.lit(BEGIN), F.replace(escape(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))


def final_messages(events: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) after folding ``events`` (conv_id, seq, turn, role, kind, text).

    A message's events are those of its ``turn``; its text is the concatenation, by ``seq``, of the texts from its last
    replacing event on, and its role that of its last event with a role ('' if none).  Null texts are empty, null kinds
    append, events with a null turn are one message, placed first.  Events with equal numbers are ordered by kind, then
    text."""
    event = F.struct("seq", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role")
    # a log that isn't dealt by conversation already is dealt by message: a long conversation meets only when it is folded
    folded = events.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(event)).alias("log"))
    last = F.array_max(F.transform("log", lambda e, i: F.when(e.kind.isin(*REPLACING), i).otherwise(0)))
    kept = F.slice("log", last + 1, F.size("log"))
    role = F.try_element_at(F.filter("log", lambda e: e.role.isNotNull()), F.lit(-1)).role
    return folded.select("conv_id", "turn", F.coalesce(role, F.lit("")).alias("role"), F.array_join(F.transform(kept, lambda e: e.text), "").alias("text"))


def render(messages: DataFrame, learned: str = "assistant") -> DataFrame:
    """One row for each conversation: ``conv_id``, ``n_turns``, ``segments`` (array of ``text`` and ``loss``) and ``formatted``,
    the segments' texts joined.  ``loss`` marks the texts of the role ``learned``, which alone are to be learned; neither the
    marks around them nor their ends are.  Messages are in order of turn, then role, then text."""
    body = escape(F.col("text"))
    turn = F.struct("turn", "role", "text", F.array(F.struct(_header(F.col("role")).alias("text"), F.lit(False).alias("loss")), F.struct(body.alias("text"), (F.col("role") == learned).alias("loss")), F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss"))).alias("parts"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: t.parts))
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments")).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))


def format_chats(events: DataFrame, learned: str = "assistant") -> DataFrame:
    """``render`` of the ``final_messages`` of an event log; an empty log gives an empty result."""
    return render(final_messages(events), learned)


def read_back(chats: DataFrame) -> DataFrame:
    """Turns parsed from ``formatted`` (array of role and text, unescaped) as ``parsed`` and the text under the loss mask of
    ``segments``, unescaped, as ``loss_text``; other columns stay."""
    # a begin mark can't stand inside a turn; what follows the last end mark is empty
    marked = F.filter(F.split("formatted", re.escape(BEGIN)), lambda x: x != "")
    turn = F.transform(marked, lambda x: F.substring_index(x, END, 1))
    role = lambda x: F.regexp_extract(x, r"(?s)\A((?:[^\\\n]|\\.)*)\n", 1)
    parsed = F.transform(turn, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(F.substr(x, F.length(role(x)) + 2)).alias("text")))
    loss = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: s.text), ""))
    return chats.withColumns({"parsed": parsed, "loss_text": loss})
