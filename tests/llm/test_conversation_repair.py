import hashlib
import random
import re
import zlib

import pytest

from inkveil.llm import conversation_repair as repair
from inkveil.llm.conversation_repair import (
    begin,
    block_table,
    crossings,
    damaged,
    last_state,
    op13_repair,
    repair_conversations,
    row_edits,
    row_table,
)
from tests.llm.edge import empty

WANTED = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute_edits(rows):
    """All shortest ways by a plain table of whole strings: rows are (initial, must go, truncated)."""
    # Prefixes of what is wanted, by their last letter.
    def follow(last, letter):
        return letter in {"": "su", "s": "u", "u": "a", "a": "u"}[last]

    level = {"": (0, "")}
    for i in range(len(rows) + 1):
        for _ in range(3):  # insertions before row i, or at the end
            for last, (cost, audit) in list(level.items()):
                for letter in "ua":
                    if follow(last, letter):
                        level[letter] = min(level.get(letter, (10**9, "")), (cost + 2, audit + "I"))
        if i == len(rows):
            break
        initial, gone, cut = rows[i]
        after = {}
        for last, (cost, audit) in level.items():
            ways = [(last, cost + 3, "D")]
            if not gone:
                ways += [(x, cost + 2 + cut, "R") for x in "ua" if follow(last, x)]
                if initial and follow(last, initial):
                    ways.append((initial, cost + cut, "K"))
            for to, price, letter in ways:
                after[to] = min(after.get(to, (10**9, "")), (price, audit + letter))
        level = after
    return min(v for k, v in level.items() if k in ("", "a"))


def symbol(row):
    initial, gone, cut = row
    return "-" if gone else initial.upper() if cut else initial


def some_rows(rng, n):
    return [(rng.choice("suax" if rng.random() < 0.3 else "ua"), *rng.choice([(0, 0), (0, 0), (0, 1), (1, 0)])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(200))
def test_edits_are_the_audit_least_of_the_cheapest(seed):
    rng = random.Random(seed)
    rows = some_rows(rng, rng.randint(1, 14))
    symbols = "".join(map(symbol, rows))
    want = brute_edits([(r[0] if r[0] in "sua" else None, r[1], r[2]) for r in rows])
    costs, ranks = block_table(symbols)
    state, cost = last_state(repair.Front(tuple(costs[:4]), tuple(ranks[:4])))
    letters, states = row_edits(symbols, repair.NONE, state)
    assert (cost, "".join(letters) + repair._TRAIL[state]) == want
    # The same through blocks of any size.
    size = rng.randint(1, 5)
    blocks = [symbols[i : i + size] for i in range(0, len(symbols), size)]
    items = []
    for block in blocks:
        c, r = block_table(block)
        items.append(tuple(tuple(zip(c[4 * s : 4 * s + 4], r[4 * s : 4 * s + 4])) for s in range(4)))
    front = begin(repair.NONE)
    for item in items:
        front = repair.ahead(front, item)
    assert last_state(front) == (state, cost)
    between = crossings(items, repair.NONE, state)
    joined = "".join("".join(row_edits(b, s, e)[0]) for b, s, e in zip(blocks, between, between[1:]))
    assert joined == "".join(letters)


def test_row_tables():
    assert row_table("u")[repair.NONE][repair.USER] == (0, "K")
    assert row_table("-")[repair.NONE][repair.USER] == (5, "ID")
    assert row_table("s")[repair.USER][repair.SYSTEM][0] == repair.NEVER


def brute(rows):
    """The contract by hand: rows are (conv, turn, role, text) as damaged, in order by conversation."""
    blank = [not re.search(r"[^\x20\x09-\x0D]", t) for _, _, _, t in rows]
    kinds, seen = [], set()
    for (_, _, role, text), empty_text in zip(rows, blank):
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        kinds.append("blank" if empty_text else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    cost, audit = brute_edits(
        [(i if i in ("s", "u", "a") else None, k in ("blank", "duplicate"), k == "truncated") for i, k in zip(initials, kinds)]
    )
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    left, out, last = list(rows), [], ""
    for letter in audit:
        target = "assistant" if last == "u" else "user"
        if letter == "I":
            out.append(f"{target}:")
        else:
            _, _, role, text = left.pop(0)
            if letter == "D":
                continue
            out.append(f"{role if letter == 'K' else target}:{text}")
        last = out[-1][0]
    assert WANTED.fullmatch("".join(line[:1] for line in out)) and not left
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, digest)


def expected(rows):
    """The query by hand over original rows."""
    fill = lambda x: " " if x is None else str(x)
    by_conv = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{fill(conv)}:{fill(turn)}".encode()) % 20
        role, text = fill(role), fill(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        by_conv[conv] += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    return [(conv, *brute(sorted(own, key=key))) for conv, own in by_conv.items()]


def check(df):
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = op13_repair(df)
    assert got.dtypes[0] == ("conv_id", "bigint") and [t for _, t in got.dtypes[1:7]] == ["bigint"] * 6
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected(rows), key=repr)
    return rows


def test_query(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def test_edges(spark):
    rng = random.Random(4)
    rows = [
        (1, None, "user", "a."), (1, None, "user", "a."), (1, 3, None, None), (1, 3, "", "b."), (1, 9, "tool", "c!"),
        (None, 1, "user", "x?"), (None, 1, "user", "x?"), (None, None, None, None),
        (2, 5, "system", ""), (3, 1, "assistant", "only."), (4, 1, "Über", " \t\n"), (-7, -3, "user", "no end"),
        (5, 1, "user", "long. " * 200_000), (5, 2, "assistant", "word" * 100_000), (5, 3, "user", " " * 1_000_000),
    ]
    for conv in range(10, 60):
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "system", "tool", "u2", "alien", None])
            rows.append((conv, rng.choice([turn, 2 * turn, None]), role, rng.choice(["Yes.", "No", "", "Why?", f"t{turn}."])))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    extra = df.selectExpr("*", "1 AS at", "2 AS k", "3 AS conv", "4 AS block", "'x' AS fault", "5 AS first", "6 AS line")
    check(extra)
    assert op13_repair(spark.createDataFrame([], SCHEMA)).count() == 0
    assert op13_repair(empty(spark).selectExpr("doc_id AS conv_id", "slot AS turn", "source AS role", "text")).count() == 0


def test_long_conversations_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 3)
    rng = random.Random(5)
    rows = []
    for conv, n in ((1, 700), (2, 40), (3, 1), (4, 90)):
        for turn in range(n):
            role = rng.choice(["user", "assistant", "system", "tool"])
            rows.append((conv, turn, role, rng.choice([f"t{turn}.", "again.", "cut", ""])))
    check(spark.createDataFrame(rows, SCHEMA).repartition(4))


def test_edits_rebuild_every_conversation(spark, sf_dir):
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    done = repair_conversations(rows)
    audits = {r["conv_id"]: r["audit"] for r in done.summary.collect()}
    edits, roles = {}, {}
    for r in sorted(done.edits.collect(), key=lambda r: (r["conv_id"], r["at"], r["k"])):
        edits[r["conv_id"]] = edits.get(r["conv_id"], "") + r["edit"]
        if r["edit"] != "D":
            roles[r["conv_id"]] = roles.get(r["conv_id"], "") + r["role"][0]
    assert {c: a for c, a in audits.items() if a} == edits
    assert all(WANTED.fullmatch(x) for x in roles.values())
