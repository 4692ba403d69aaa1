import hashlib
import random
import zlib

import pytest

from inkveil.llm import prefix_trie as trie
from inkveil.llm.prefix_trie import numbered_turns, op11_prefix_trie, prefix_trie, rebuilt_turns
from tests.llm.edge import empty

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    """The contract's conversations by hand: (role, text) by id."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(convs):
    """All nodes of whole sequences, by plain dictionaries."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
        leaves[node] = leaves.get(node, 0) or 1
        saved[node] = saved.get(node, 0) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        if node:
            leaves[node[:-1]] = leaves.get(node[:-1], 0) + leaves[node]
            saved[node[:-1]] = saved.get(node[:-1], 0) + saved[node]
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((
            min(own), len(node), parent, len(own), children.get(node, 0), leaves[node], saved[node],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def check(df):
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = op11_prefix_trie(df)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    want = brute(rebuilt(rows))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_query(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def awkward():
    rng = random.Random(3)
    rows = [
        (None, 1, "user", "x"), (None, None, None, None), (0, None, None, None), (0, 2, "user", ""), (0, 2, "user", ""),
        (7, 1, "user", None), (250, 1, "a", "only own"), (251, 0, "", ""), (-5, 1, "user", "below"), (-105, 1, "user", "below"),
        (10**15, 1, "user", "far"), (300, 1, "user", "word " * 300_000), (301, 1, "user", "word " * 300_000), (302, 1, "user", " " * 1_000_000),
    ]
    for conv in range(400, 560):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "漢字🎈"])))
    return rows


def test_edges(spark):
    df = spark.createDataFrame(awkward(), SCHEMA).repartition(5)
    check(df.selectExpr("*", "1 AS at", "2 AS depth", "3 AS h1", "'x' AS chars", "4 AS band", "5 AS n", "6 AS position"))
    assert op11_prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert op11_prefix_trie(empty(spark).selectExpr("doc_id AS conv_id", "slot AS turn", "source AS role", "text")).count() == 0


@pytest.mark.parametrize("height", [2, 3, 5])
def test_deep_conversations_through_several_levels_of_bands(spark, monkeypatch, height):
    rng = random.Random(height)
    rows, shared = [], [("user", f"s{i}") for i in range(70)]
    for conv in range(30):
        turns = shared[: rng.choice([0, 1, 5, 33, 64, 70])] + [("user", rng.choice("ab")) for _ in range(rng.randint(0, 40))]
        rows += [(conv, i, *turn) for i, turn in enumerate(turns or [("user", "z")])]
    monkeypatch.setattr(trie, "BLOCK_BITS", 3)
    monkeypatch.setattr(trie, "ID_BITS", 2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = prefix_trie(rebuilt_turns(numbered_turns(df)), height)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rebuilt(rows)), key=repr)
