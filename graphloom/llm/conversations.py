"""Repair of conversations by error-correcting Earley parsing of their roles.

A role grammar says what a sound conversation is: nothing, or question and answer in turn, perhaps after one
system row. Beside the grammar stand error productions with costs: a terminal may be read off a row of another
role (rerole), be read off no row (insert), and a row may be read as nothing (delete). An item of the chart is a
rule with a dot in it and keeps the least (cost, audit) of all ways to it; the audit has one letter for each edit.
The rules are left-linear, so every item starts at the first row and a set of the chart holds a few items,
whatever the length. The completed chart's least item is the repair.

Rows are range partitioned and sorted by conversation and turn, so a conversation with a third of all rows is
dealt to many tasks. Each task cuts what it reads into segments of at most ``SEGMENT`` rows. A segment that is a
whole conversation is repaired at once; for one that may be part of a longer one, the chart is filled from each
state in which the part before it can end. These tables of transitions are then chained by conversation, without texts, and
the texts of these few conversations pass once more, in order, to be written out. Two audits of equal cost never begin each other,
so what is best for parts is best for the whole.

Null roles and texts are one space, rows of a null conversation are one conversation, and null turns come first.
Rows of one turn are ordered by role and text (by code point); equal rows are counted first and then follow each other. A very
long text is held by one task. An empty table gives no rows; a conversation with no rows left has zeros and an empty audit.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import require, stored

#: Rows of a segment at most, and bytes of text from which a segment is closed.
SEGMENT, SEGMENT_BYTES = 500, 8 << 20
#: The role grammar by role initials; a conversation is empty or ends as ``Answered``.
RULES = [("Opened", ("s",)), ("Asked", ("u",)), ("Asked", ("Opened", "u")), ("Asked", ("Answered", "u")), ("Answered", ("Asked", "a"))]
#: Roles that rows can be given or inserted with.
ROLES = {"u": "user", "a": "assistant"}
REROLE, INSERT, DELETE, TRUNCATED = 2, 2, 3, 1
#: Where the part before a segment can end: before the first terminal, or after a nonterminal.
STATES = ("", "Opened", "Asked", "Answered")
_BLANK = " \t\n\v\f\r"

Value = tuple[int, str]
Item = tuple[int, int]


def _set(agenda: list[tuple[int, str, Item]]) -> dict[Item, Value]:
    """A set of the chart: items, by least value, that inserts and completion reach from the given ones."""
    heapq.heapify(agenda)
    done: dict[Item, Value] = {}
    while agenda:
        cost, audit, item = heapq.heappop(agenda)
        if item in done:
            continue
        done[item] = cost, audit
        head, body = RULES[item[0]]
        if item[1] == len(body):
            for number, (_, other) in enumerate(RULES):
                if other[0] == head:
                    heapq.heappush(agenda, (cost, audit, (number, 1)))
        elif body[item[1]] in ROLES:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", (item[0], item[1] + 1)))
    return done


@functools.lru_cache(20_000)
def parsed(rows: str, state: str = "") -> dict[str, Value]:
    """The least (cost, audit) for each state after the rows, from ``state`` before them.

    Two characters for each row: its role's initial (or ``?``), and ``x`` if it has to go, ``t`` if it is truncated.
    """
    items = [(0, "", (number, 1 if state else 0)) for number, (_, body) in enumerate(RULES) if body[0] == state or not state and len(body) == 1]
    chart = _set(items)
    for at in range(0, len(rows), 2):
        initial, fault = rows[at], rows[at + 1]
        extra = TRUNCATED if fault == "t" else 0
        agenda = []
        for (number, dot), (cost, audit) in chart.items():
            body = RULES[number][1]
            if dot == len(body):
                continue
            agenda.append((cost + DELETE, audit + "D", (number, dot)))
            if fault != "x":
                if body[dot] == initial:
                    agenda.append((cost + extra, audit + "K", (number, dot + 1)))
                elif body[dot] in ROLES:
                    agenda.append((cost + extra + REROLE, audit + "R", (number, dot + 1)))
        chart = _set(agenda)
    ends: dict[str, Value] = {}
    for (number, dot), value in chart.items():
        body = RULES[number][1]
        if dot < len(body):
            name = body[dot - 1] if dot else ""
            ends[name] = min(value, ends.get(name, value))
    return ends


def accepted(ends: dict[str, Value]) -> Value:
    """The least value of a whole conversation."""
    return min(ends[name] for name in ("", "Answered") if name in ends)


def edited(rows: list[tuple[str, str]], audit: str, state: str) -> tuple[list[tuple[str, str]], str]:
    """(role, text) of the rows after the edits of an audit, and the state after them."""
    out, at = [], 0
    for edit in audit:
        expected = "a" if state == "Asked" else "u"
        if edit == "I":
            out.append((ROLES[expected], ""))
        else:
            role, text = rows[at]
            at += 1
            if edit == "D":
                continue
            out.append((role if edit == "K" else ROLES[expected], text))
            if edit == "K" and not state and role[:1] == "s":
                state = "Opened"
                continue
        state = "Answered" if expected == "a" else "Asked"
    return out, state


def _lines(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in turns)


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_RESULT = "conv string, gaps string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, turns array<struct<role:string,text:string>>"
_SEGMENT = _RESULT + ", segment long, rows string, ways array<struct<before:string,after:string,cost:long,audit:string>>, distinct long, first string, last string, head string, tail string, lines array<struct<role:string,text:string>>"
_RESULT_NAMES, _SEGMENT_NAMES = ([c.split()[0] for c in s.split(", ")] for s in (_RESULT, _SEGMENT))


class Part:
    """Rows of a conversation as they come, and what is known of them."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, str]] = []
        self.rows: list[str] = []
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.size = self.distinct = 0
        self.first: int | None = None
        self.last: int | None = None
        self.head = self.tail = ""

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        seen = text.strip(_BLANK)
        fault = "blank" if not seen else "duplicate" if repeated else "truncated" if seen[-1] not in ".!?" else ""
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.lines:
            self.counts["illegal"] += self.tail + initial not in ("su", "ua", "au")
        else:
            self.head = initial
        self.tail = initial
        if turn is not None and turn != self.last:
            self.distinct += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        self.lines.append((role, text))
        self.rows.append((initial if initial in ("s", "u", "a") else "?") + ("x" if fault in ("blank", "duplicate") else "t" if fault else "-"))
        self.size += len(text)

    @property
    def full(self) -> bool:
        return len(self.lines) >= SEGMENT or self.size >= SEGMENT_BYTES


def _gaps(first: int | None, last: int | None, distinct: int) -> int:
    return 0 if first is None else last - first + 1 - distinct


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after a damage that a checksum of conversation and turn decides: one of twenty each is
    dropped, emptied, stripped of sentence marks, repeated (``copies``), or given the role user."""
    conv, turn = F.col("conv_id"), F.col("turn")
    kind = F.crc32(F.concat(*(x for c in (conv, F.lit(":"), turn) for x in (F.coalesce(c.cast("string"), F.lit(" ")),)))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Different rows in order, with how often each occurs and whether its role and text were seen before."""
    copies: Column = F.col("copies") if "copies" in rows.columns else F.lit(1)
    counted = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("long").alias("n"))
    counted = counted.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("content", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    first = counted.groupBy(F.col("conv_id").alias("of"), F.col("content").alias("same")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("later"), "turn")).alias("first"))
    known = counted.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("content") == F.col("same")))
    order = ["conv_id", "turn", "role", "text"]
    rows = known.select(*order, "n", (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("seen"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"), "role", "text", "n", "seen")


def _segmented(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each segment: the result, if it is a whole conversation, or what is needed to chain it."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    out: list[tuple] = []

    def close(part: Part, conv: str | None, whole: bool) -> None:
        nonlocal number
        number += 1
        rows, counts = "".join(part.rows), [part.counts[c] for c in _COUNTS]
        if whole:
            cost, audit = accepted(parsed(rows))
            turns, _ = edited(part.lines, audit, "")
            out.append((conv, str(_gaps(part.first, part.last, part.distinct)), *counts, cost, audit, hashlib.sha256(_lines(turns).encode()).hexdigest(), turns, number, *[None] * 8))
        else:
            ways = [(before, after, *value) for before in STATES for after, value in parsed(rows, before).items()]
            first, last = (None if t is None else str(t) for t in (part.first, part.last))
            out.append((conv, None, *counts, None, None, None, None, number, rows, ways, part.distinct, first, last, part.head, part.tail, part.lines))

    def ready() -> pd.DataFrame:
        made = pd.DataFrame(out, columns=_SEGMENT_NAMES).astype({c: "Int64" for c in ("cost", "distinct")})
        out.clear()
        return made

    part, conv, open_ = None, None, True  # the first conversation of a partition may have begun before
    for batch in batches:
        for name, turn, role, text, n, seen in zip(batch["conv"], batch["turn"], batch["role"], batch["text"], batch["n"], batch["seen"], strict=True):
            if part is None or name != conv:
                if part is not None:
                    close(part, conv, not open_)
                    open_ = False
                part, conv = Part(), name
            for copy in range(n):
                if part.full:
                    close(part, conv, False)
                    part, open_ = Part(), True
                part.add(None if turn is None else int(turn), role, text, bool(seen) or copy > 0)
            if len(out) >= 200:
                yield ready()
    if part is not None:
        close(part, conv, False)  # the last one may go on after
    if out:
        yield ready()


_CHAINED = "conv string, segment long, state string, slice string, gaps string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_CHAINED_NAMES = [c.split()[0] for c in _CHAINED.split(", ")]


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edits of each segment, from the segments of each conversation in order; the last has the totals."""

    def settle(conv: str | None, held: list) -> pd.DataFrame:
        ways: dict[str, Value] = {"": (0, "")}
        totals, illegal, first, last, distinct, tail = [0] * 4, 0, None, None, 0, None
        for s in held:
            nexts: dict[str, Value] = {}
            for w in s.ways:
                if w["before"] in ways:
                    cost, audit = ways[w["before"]]
                    value = cost + int(w["cost"]), audit + w["audit"]
                    nexts[w["after"]] = min(value, nexts.get(w["after"], value))
            ways = nexts
            totals = [a + b for a, b in zip(totals, (s.blank, s.duplicate, s.truncated, s.illegal), strict=True)]
            illegal += tail is not None and tail + s.head not in ("su", "ua", "au")
            tail = s.tail
            if s.first is not None:
                distinct += int(s.distinct) - (last == int(s.first))
                first, last = int(s.first) if first is None else first, int(s.last)
        cost, audit = accepted(ways)
        rows, at, state = [], 0, ""
        for i, s in enumerate(held):
            end, left = at, len(s.rows) // 2
            while left:
                left -= audit[end] != "I"
                end += 1
            end = len(audit) if i + 1 == len(held) else end
            rows.append([conv, s.segment, state, audit[at:end], *[None] * 7])
            state = edited([(s.rows[j], "") for j in range(0, len(s.rows), 2)], audit[at:end], state)[1]
            at = end
        rows[-1][4:] = [str(_gaps(first, last, distinct)), *totals[:3], totals[3] + illegal, cost, audit]
        return pd.DataFrame(rows, columns=_CHAINED_NAMES).astype({c: "Int64" for c in (*_COUNTS, "cost")})

    held: list = []
    for batch in batches:
        for s in batch.itertuples(index=False):
            if held and s.conv != held[0].conv:
                yield settle(held[0].conv, held)
                held = []
            held.append(s)
    if held:
        yield settle(held[0].conv, held)


def _written(with_turns: bool):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Results of the conversations that were chained; their texts pass in order."""
        told, begun, state, turns = hashlib.sha256(), False, "", []
        for batch in batches:
            out = []
            for s in batch.itertuples(index=False):
                made, state = edited([(x["role"], x["text"]) for x in s.lines], s.slice, s.state)
                if made:
                    told.update(("\n" * begun + _lines(made)).encode())
                    begun = True
                if with_turns:
                    turns += made
                if s.audit is not None:
                    out.append((s.conv, s.gaps, *map(int, (s.blank, s.duplicate, s.truncated, s.illegal, s.cost)), s.audit, told.hexdigest(), turns))
                    told, begun, turns = hashlib.sha256(), False, []
            if out:
                yield pd.DataFrame(out, columns=_RESULT_NAMES)

    return task


def repaired(rows: DataFrame, conversations: DataFrame, with_turns: bool = False) -> DataFrame:
    """Per conversation of ``conversations`` (conv_id): gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 of its ``rows`` (conv_id, turn, role, text and, perhaps, copies) and, ``with_turns``, the repaired turns."""
    require(rows, ("conv_id", "turn", "role", "text"))
    require(conversations, ("conv_id",))
    segments = stored(_ordered(rows).mapInPandas(_segmented, _SEGMENT), "segments")
    result = [c for c in _RESULT_NAMES if with_turns or c != "turns"]
    whole = segments.filter("audit is not null").select(*result)
    parts = segments.filter("audit is null")
    named = ["conv", "segment", "rows", "ways", *_COUNTS, "first", "last", "distinct", "head", "tail"]
    chained = stored(parts.select(*named).repartition("conv").sortWithinPartitions("conv", "segment").mapInPandas(_chained, _CHAINED), "chained")
    texts = parts.select(F.col("segment").alias("at"), "lines")
    written = chained.join(texts, F.col("segment") == F.col("at")).drop("at").repartition("conv").sortWithinPartitions("conv", "segment").mapInPandas(_written(with_turns), _RESULT).select(*result)
    every = conversations.select(F.col("conv_id").cast("string").alias("of")).distinct()
    found = every.join(whole.unionByName(written), F.col("of").eqNullSafe(F.col("conv")), "left")
    zeros = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("gaps", *_COUNTS, "cost")]
    out = [F.col("of").cast(conversations.schema["conv_id"].dataType).alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")]
    return found.select(*out, *([F.coalesce("turns", F.array().cast("array<struct<role:string,text:string>>")).alias("turns")] if with_turns else []))
