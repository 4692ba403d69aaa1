"""Conversation repair: the cheapest edits that make the turns of a conversation alternate.

What is wanted is ``(s?(ua)+)?`` by the initials of the roles: nothing, or a
system turn or none and then user and assistant in turn.  Its automaton has
four states: nothing yet, behind the system turn, behind a user, behind an
assistant.  A row is kept, given another role or deleted, and empty turns may
be inserted before it; from a state each of these leads to one state, so edits
and their audit (one letter each) are the same thing.

Hirschberg's divide and conquer finds them in linear space.  For a stretch of
rows between two known states, a vector of four costs goes forward from its
start and another backward from its end; where they meet, in the middle, the
state of least sum is crossed, and of several the one whose audit so far is
least; both halves follow alike.  The forward vector carries the order of the
four audits as ranks, never the audits: none is the beginning of another, as
all end with the letter of the same row.

A conversation is first cut into blocks of rows.  Each block becomes a table of
costs and ranks from every state to every other, the same divide and conquer
runs over these tables, and then within each block on its own.  So the rows of
one conversation lie in many tasks, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import ordered_sha256, partitions, small_batches, stored
from inkveil.operators.skew import join_groups

BLOCK_BITS = 12
STATES = range(4)
NONE, SYSTEM, USER, ASSISTANT = STATES
NEVER = 1 << 60
# Where a turn of this initial leads; and where an edit that chooses its role does.
_NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_CHOSEN = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# From each state, the insertions that end a conversation well.
_TRAIL = ("", "II", "I", "")

Table = tuple[tuple[tuple[int, object], ...], ...]  # [from][to]: cost, and what orders audits from one state


@lru_cache(maxsize=None)
def row_table(symbol: str) -> Table:
    """Costs and letters of a row by the states before and behind it.

    Symbols are initials (``x`` for any other than s, u and a), in upper case
    where the text is truncated, and ``-`` for rows that must go.  More than
    two insertions in a row lead back to a state that was had for less.
    """
    extra = TRUNCATED if symbol.isupper() else 0
    out = []
    for start in STATES:
        best = [(NEVER, "")] * 4
        state, cost, letters = start, 0, ""
        for _ in range(3):
            ways = [(state, DELETE, "D")]
            if symbol != "-":
                ways.append((_CHOSEN[state], REROLE + extra, "R"))
                if (kept := _NEXT[state].get(symbol.lower())) is not None:
                    ways.append((kept, KEEP + extra, "K"))
            for to, price, letter in ways:
                best[to] = min(best[to], (cost + price, letters + letter))
            state, cost, letters = _CHOSEN[state], cost + INSERT, letters + "I"
        out.append(tuple(best))
    return tuple(out)


class Front(NamedTuple):
    """The least cost to each state, and the order of the audits that lead there."""

    costs: tuple[int, ...]
    ranks: tuple[int, ...]


def begin(state: int) -> Front:
    return Front(tuple(0 if s == state else NEVER for s in STATES), (0,) * 4)


def ahead(front: Front, table: Table) -> Front:
    """The front behind one more row or block."""
    best = []
    for to in STATES:
        ways = [
            (front.costs[s] + table[s][to][0], front.ranks[s], table[s][to][1])
            for s in STATES
            if front.costs[s] < NEVER and table[s][to][0] < NEVER
        ]
        best.append(min(ways, default=None))
    order = {key: i for i, key in enumerate(sorted(b[1:] for b in best if b))}
    return Front(
        tuple(b[0] if b else NEVER for b in best), tuple(order[b[1:]] if b else len(order) for b in best)
    )


def behind(costs: tuple[int, ...], table: Table) -> tuple[int, ...]:
    """The least cost from each state to the end, one row or block earlier."""
    return tuple(min(NEVER, *(table[s][to][0] + costs[to] for to in STATES)) for s in STATES)


class _Rows:
    """Fronts over rows: few differ but for a constant, so each step is worked out once."""

    def __init__(self) -> None:
        self.forward: dict = {}
        self.backward: dict = {}

    def ahead(self, front: Front, symbol: str) -> Front:
        low = min(front.costs)
        key = tuple(c - low if c < NEVER else NEVER for c in front.costs), front.ranks, symbol
        if key not in self.forward:
            self.forward[key] = ahead(Front(*key[:2]), row_table(symbol))
        found = self.forward[key]
        return Front(tuple(c + low if c < NEVER else NEVER for c in found.costs), found.ranks)

    def behind(self, costs: tuple[int, ...], symbol: str) -> tuple[int, ...]:
        low = min(costs)
        key = tuple(c - low if c < NEVER else NEVER for c in costs), symbol
        if key not in self.backward:
            self.backward[key] = behind(key[0], row_table(symbol))
        return tuple(c + low if c < NEVER else NEVER for c in self.backward[key])


_ROWS = _Rows()


def crossings(items: Sequence, start: int, end: int, step=ahead, back=behind) -> list[int]:
    """The states before, between and behind ``items`` on the audit-least cheapest way."""
    states = [start] * (len(items) + 1)
    states[-1] = end
    todo = [(0, len(items))]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        front = begin(states[low])
        for i in range(low, middle):
            front = step(front, items[i])
        rest = begin(states[high]).costs
        for i in range(high - 1, middle - 1, -1):
            rest = back(rest, items[i])
        states[middle] = min(STATES, key=lambda s: (front.costs[s] + rest[s], front.ranks[s]))
        todo += [(low, middle), (middle, high)]
    return states


def block_table(symbols: str) -> tuple[list[int], list[int]]:
    """Costs and ranks from every state to every other over a block, row by row."""
    costs, ranks = [], []
    for start in STATES:
        front = begin(start)
        for symbol in symbols:
            front = _ROWS.ahead(front, symbol)
        costs += front.costs
        ranks += front.ranks
    return costs, ranks


def row_edits(symbols: str, start: int, end: int) -> tuple[list[str], list[int]]:
    """The letters of each row of a block that is entered and left by these states, and the states between."""
    states = crossings(symbols, start, end, _ROWS.ahead, _ROWS.behind)
    return [row_table(s)[a][b][1] for s, a, b in zip(symbols, states, states[1:])], states


def last_state(front: Front) -> tuple[int, int]:
    """The state behind the last row on the audit-least cheapest way, and the whole cost."""
    whole = [c + INSERT * len(t) for c, t in zip(front.costs, _TRAIL)]
    state = min(STATES, key=lambda s: (whole[s], front.ranks[s]))
    return state, whole[state]


def played(letters: str, state: int) -> list[dict]:
    """Each edit with the role it gives; None where the row's own stays."""
    out = []
    for letter in letters:
        chosen = _CHOSEN[state]
        out.append({"edit": letter, "role": _ROLE[chosen] if letter in "IR" else None})
        if letter in "IR":
            state = chosen
    return out


_EDITS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string())]))
_TABLE_DDL = "struct<costs: array<bigint>, ranks: array<int>, illegal: bigint>"
_WAY_DDL = "struct<states: array<int>, cost: bigint, illegal: bigint, trail: array<struct<edit: string, role: string>>>"


def _tables(symbols: pa.Array, initials: pa.Array) -> pa.Array:
    done = []
    for rows, own in zip(symbols.to_pylist(), initials.to_pylist(), strict=True):
        costs, ranks = block_table(rows)
        done.append({"costs": costs, "ranks": ranks, "illegal": _illegal(own)})
    kind = pa.struct([("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("illegal", pa.int64())])
    return pa.array(done, type=kind)


def _illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _ways(blocks: pa.Array) -> pa.Array:
    """By conversation, its blocks' tables in order: the states between them, and what ends it."""
    done = []
    for tables in blocks.to_pylist():
        items = [
            tuple(tuple(zip(t["costs"][4 * s : 4 * s + 4], t["ranks"][4 * s : 4 * s + 4])) for s in STATES)
            for t in tables
        ]
        front = begin(NONE)
        for item in items:
            front = ahead(front, item)
        state, cost = last_state(front)
        seams = "".join(t["first"] + t["last"] for t in tables)[1:-1]
        illegal = sum(t["illegal"] for t in tables) + sum(
            _illegal(seams[i : i + 2]) for i in range(0, len(seams), 2)
        )
        done.append(
            {
                "states": crossings(items, NONE, state),
                "cost": cost,
                "illegal": illegal,
                "trail": played(_TRAIL[state], state),
            }
        )
    kind = pa.struct(
        [("states", pa.list_(pa.int32())), ("cost", pa.int64()), ("illegal", pa.int64()), ("trail", _EDITS)]
    )
    return pa.array(done, type=kind)


def _block_edits(symbols: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    done = []
    for rows, start, end in zip(symbols.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
        letters, states = row_edits(rows, start, end)
        done.append([played(x, s) for x, s in zip(letters, states)])
    return pa.array(done, type=pa.list_(_EDITS))


_BLANKS = " \t\n\x0b\x0c\r"


def _filled(column: Column, kind: str = "string") -> Column:
    return F.coalesce(column.cast(kind), F.lit(" "))


def _ordered(rows: DataFrame) -> DataFrame:
    """Stored rows with ``at``, a number that grows along (conv_id, turn, role, text).

    Rows are dealt by ranges, so a long conversation lies in several tasks;
    bounds look at the beginning of a text only, so none travels whole.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(
        partitions(spark), "conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 64)
    ).sortWithinPartitions("conv_id", "turn", "role", "text")
    return stored(placed.withColumn("at", F.monotonically_increasing_id()), "turns")


def _faults(rows: DataFrame) -> DataFrame:
    """Each row's ``conv_id, at, initial, fault``; of several faults the first counts."""
    initial = F.substring("role", 1, 1)
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    narrow = stored(
        rows.select(
            F.struct("conv_id").alias("conv"),
            "at",
            F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
            same.alias("same"),
            F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")).alias("filled"),
            F.substring(F.rtrim("text", F.lit(_BLANKS)), -1, 1).isin(".", "!", "?").alias("ended"),
        ),
        "turns",
    )
    # Stored, as a join of two plain shuffles can be split where a text is hot.
    repeated = narrow.groupBy("conv", "same").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    firsts = stored(repeated.filter("n > 1").select("conv", "same", "first"), "turns")
    fault = (
        F.when(~F.col("filled"), "blank")
        .when(F.col("at") > F.col("first"), "duplicate")
        .when(~F.col("ended"), "truncated")
    )
    return narrow.join(firsts, ["conv", "same"], "left").select("conv", "at", "initial", fault.alias("fault"))


def _blocks(faults: DataFrame) -> DataFrame:
    """Stored blocks of at most ``2**BLOCK_BITS`` rows: symbols, tables and counts."""
    symbol = (
        F.when(F.col("fault").isin("blank", "duplicate"), "-")
        .when(F.col("fault") == "truncated", F.upper("initial"))
        .otherwise(F.col("initial"))
    )
    row = F.struct("at", symbol.alias("symbol"), "initial")
    grouped = faults.groupBy("conv", F.shiftright("at", BLOCK_BITS).alias("block")).agg(
        F.sort_array(F.collect_list(row)).alias("rows"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    tables = F.arrow_udf(_tables, _TABLE_DDL).asNondeterministic()
    return stored(
        grouped.withColumns(
            {
                "ats": F.transform("rows", lambda r: r["at"]),
                "symbols": F.array_join(F.transform("rows", lambda r: r["symbol"]), ""),
                "initials": F.array_join(F.transform("rows", lambda r: r["initial"]), ""),
            }
        ).select(
            "conv", "block", "ats", "symbols", "blank", "duplicate", "truncated",
            F.substring("initials", 1, 1).alias("first"),
            F.substring("initials", -1, 1).alias("last"),
            tables(F.col("symbols"), F.col("initials")).alias("table"),
        ),
        "blocks",
    )


class Repair(NamedTuple):
    """``edits (conv_id, at, k, edit, role, text)`` in the order of (at, k), and a ``summary`` by conversation."""

    edits: DataFrame
    summary: DataFrame


def repair_conversations(rows: DataFrame) -> Repair:
    """The cheapest repair of every conversation of ``rows (conv_id, turn, role, text)``.

    ``edits`` has one row per letter of the audit: Keep, Rerole, Delete (with
    the row's own role and text) and Insert (with an empty text).  ``summary``
    is ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)``.

    NULL roles and texts are one space; rows come by turn, NULL turns first,
    ties by role and text; rows without an id are one conversation; repeated
    rows are duplicates; texts of any length and other columns (not read) do
    no harm; an empty table gives two empty ones.  A task holds a block of
    rows without their texts, or the tables of one conversation's blocks; an
    audit is one value.
    """
    small_batches(rows.sparkSession)
    clean = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        _filled(F.col("role")).alias("role"),
        _filled(F.col("text")).alias("text"),
    )
    turns = _ordered(clean)
    blocks = _blocks(_faults(turns))
    ways = stored(_conversations(blocks), "ways")
    edited = stored(_within(blocks, ways), "edits")
    return Repair(_edits(turns, edited, ways), _summary(turns, edited, ways))


def _conversations(blocks: DataFrame) -> DataFrame:
    """By conversation: the numbers of its blocks, the way through them, and the counts of faults."""
    table = F.struct(
        "block", "first", "last", F.col("table.costs").alias("costs"),
        F.col("table.ranks").alias("ranks"), F.col("table.illegal").alias("illegal"),
    )
    whole = blocks.groupBy("conv").agg(
        F.sort_array(F.collect_list(table)).alias("tables"),
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    ways = F.arrow_udf(_ways, _WAY_DDL).asNondeterministic()
    return whole.withColumn("way", ways(F.col("tables"))).select(
        "conv", "blank", "duplicate", "truncated", "way",
        F.transform("tables", lambda t: t["block"]).alias("blocks"),
    )


def _within(blocks: DataFrame, ways: DataFrame) -> DataFrame:
    """By block ``(conv, block, ats, edits)``: the edits of each of its rows."""
    pairs = F.transform(
        "blocks",
        lambda b, i: F.struct(
            b.alias("block"),
            F.get(F.col("way.states"), i).alias("start"),
            F.get(F.col("way.states"), i + 1).alias("end"),
        ),
    )
    states = ways.select("conv", F.inline(pairs))
    edit = F.arrow_udf(_block_edits, "array<array<struct<edit: string, role: string>>>").asNondeterministic()
    return blocks.join(states, ["conv", "block"]).select(
        "conv", "block", "ats", edit(F.col("symbols"), F.col("start"), F.col("end")).alias("edits")
    )


def _edits(turns: DataFrame, edited: DataFrame, ways: DataFrame) -> DataFrame:
    by_row = edited.select(F.inline(F.arrays_zip("ats", "edits"))).withColumnRenamed("ats", "at")
    each = turns.join(by_row, "at").select("conv_id", "at", "role", "text", F.posexplode("edits").alias("k", "e"))
    own = each.select(
        "conv_id", "at", "k", F.col("e.edit").alias("edit"),
        F.coalesce("e.role", "role").alias("role"),
        F.when(F.col("e.edit") == "I", "").otherwise(F.col("text")).alias("text"),
    )
    trail = ways.select(F.col("conv.conv_id").alias("conv_id"), F.posexplode("way.trail").alias("k", "e")).select(
        "conv_id", F.lit(2**63 - 1).alias("at"), "k", F.col("e.edit").alias("edit"),
        F.col("e.role").alias("role"), F.lit("").alias("text"),
    )
    return own.unionByName(trail)


def _summary(turns: DataFrame, edited: DataFrame, ways: DataFrame) -> DataFrame:
    letters = F.flatten(F.transform("edits", lambda row: F.transform(row, lambda e: e["edit"])))
    audits = edited.select("conv", F.struct("block", F.array_join(letters, "").alias("part")).alias("part"))
    audits = audits.groupBy("conv").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    gaps = turns.groupBy(F.struct("conv_id").alias("conv")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps")
    )
    trail = F.array_join(F.transform("way.trail", lambda e: e["edit"]), "")
    return (
        ways.join(audits, "conv")
        .join(gaps, "conv")
        .select(
            F.col("conv.conv_id").alias("conv_id"), "gaps", "blank", "duplicate", "truncated",
            F.col("way.illegal").alias("illegal"), F.col("way.cost").alias("cost"),
            F.concat(F.array_join(F.transform("parts", lambda p: p["part"]), ""), trail).alias("audit"),
        )
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that ``crc32(conv_id:turn) % 20`` gives them."""
    key = F.concat(_filled(F.col("conv_id")), F.lit(":"), _filled(F.col("turn")))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        _filled(F.col("role")).alias("role"),
        _filled(F.col("text")).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("fault"),
    ).filter("fault <> 0")
    text = (
        F.when(F.col("fault") == 1, "")
        .when(F.col("fault") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op13_repair(conversations: DataFrame) -> DataFrame:
    """The contract's columns: the summary of every original conversation and its repaired turns' hash."""
    done = repair_conversations(damaged(conversations))
    lines = done.edits.filter("edit <> 'D'").select(
        "conv_id", "at", "k", F.concat("role", F.lit(":"), "text").alias("line")
    )
    digests = ordered_sha256(lines, ["conv_id"], ["at", "k"], "line", "\n")
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    joined = join_groups(join_groups(every, done.summary, ["conv_id"]), digests, ["conv_id"])
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
