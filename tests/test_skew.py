import random

import pytest

from inkveil.operators import skew
from inkveil.operators.manifest import dedup_inputs, last_write_wins
from inkveil.operators.naming import output_names


@pytest.fixture(params=[21, 2])
def bits(request, monkeypatch):
    """Blocks of the normal size, and of four rows so that all levels are used."""
    monkeypatch.setattr(skew, "BLOCK_BITS", request.param)


def rows_with_hot_key(n=400, seed=3):
    rng = random.Random(seed)
    orders = rng.sample(range(-(10**6), 10**15), n - n // 2) + list(range(n // 2))
    return [(rng.choice(["hot"] * 5 + ["b", "c", None]), o, rng.randrange(4)) for o in orders]


def test_running_total(spark, bits):
    rows = rows_with_hot_key()
    df = spark.createDataFrame(rows, "k string, o bigint, w int").repartition(5)
    got = skew.running_total(df, ["k"], "o", "w", into="run", total_into="all").collect()
    assert len(got) == len(rows)
    for row in got:
        same = [r for r in rows if r[0] == row.k]
        assert row.run == sum(w for _, o, w in same if o <= row.o)
        assert row["all"] == sum(w for _, _, w in same)


def test_numbering_without_keys_repeated(spark, bits):
    rows = rows_with_hot_key(120)
    df = spark.createDataFrame(rows, "k string, o bigint, w int")
    got = {(r.k, r.o): r.position for r in skew.running_total(df, ["k"], "o").collect()}
    for k, o, _ in rows:
        assert got[k, o] == sum(1 for r in rows if r[0] == k and r[1] <= o)


def test_spread_lookup(spark, bits):
    rows = rows_with_hot_key(120)
    df = spark.createDataFrame(rows, "k string, o bigint, w int")
    groups = spark.createDataFrame([("hot", 1), (None, 2), ("c", 3)], "k string, v int")
    got = skew.spread_lookup(df, groups, ["k"], "o").collect()
    assert len(got) == len(rows)
    assert all(r.v == {"hot": 1, None: 2, "c": 3}.get(r.k) for r in got)


def test_last_write_and_first_entry(spark, bits):
    rows = [(o, k, w or None, f"{o}") for k, o, w in rows_with_hot_key(150)]
    df = spark.createDataFrame(rows, "seq bigint, name string, size int, content string")
    last = last_write_wins(df).collect()
    assert len(last) == len(rows)
    for r in last:
        assert r.content == str(max(o for o, name, _, _ in rows if name == r.name))
    first = {(r.name, r.size): r.seq for r in dedup_inputs(df).collect()}
    assert first == {
        (n, s): min(o for o, name, size, _ in rows if (name, size) == (n, s))
        for _, n, s, _ in rows
    }


def names_by_hand(rows, taken):
    """Lowest free name, one file after the other."""
    out, used = {}, set(taken)
    for run, seq, name, ok in sorted(rows, key=lambda r: r[1]):
        if not ok:
            out[run, seq] = ""
            continue
        stem = name.rsplit(".", 1)[0] if 0 < name.rfind(".") < len(name) - 1 else name
        candidate, i = f"{stem}_redacted.md", 2
        while (run, candidate) in used:
            candidate, i = f"{stem}_redacted_{i}.md", i + 1
        used.add((run, candidate))
        out[run, seq] = candidate
    return out


def test_null_keys_are_kept(spark):
    rows = [(1, None, 5), (2, "a", None), (3, "a", 3), (4, "a", 3), (5, None, 5), (6, "a", None)]
    df = spark.createDataFrame(rows, "seq bigint, name string, size int")
    assert sorted(r.seq for r in dedup_inputs(df).collect()) == [1, 2, 3]
    listed = df.selectExpr("seq", "name", "cast(seq as string) AS content")
    assert {r.seq: r.content for r in last_write_wins(listed).collect()} == {
        1: "5", 5: "5", 2: "6", 3: "6", 4: "6", 6: "6",
    }


@pytest.mark.parametrize("with_existing", [False, True])
def test_output_names(spark, bits, with_existing):
    rng = random.Random(5)
    names = ["a.txt", "a.md", "a.tar.gz", "a", ".rc", "b.TXT", "b.", "x_redacted_2.md", "é ü.pdf"]
    rows = [
        (rng.choice("rs"), i, rng.choice(names + ["a.txt"] * 9), rng.random() < 0.8)
        for i in range(300)
    ]
    taken = [(r, f"a_redacted{e}.md") for r in "rs" for e in ("", "_2", "_3", "_7", "_9", "_40", "_02", "_1")]
    taken += [("r", "other.md"), ("r", "x_redacted_2_redacted.md"), ("r", "a_redacted_3.md")]
    df = spark.createDataFrame(rows, "run_id string, seq bigint, name string, ok boolean")
    existing = spark.createDataFrame(taken, "run_id string, output string") if with_existing else None
    got = output_names(df, ["run_id"], ok="ok", existing=existing).collect()
    expected = names_by_hand(rows, taken if with_existing else [])
    assert {(r.run_id, r.seq): r.output for r in got} == expected


def test_checked_broadcast(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    big = spark.range(1000).withColumnRenamed("id", "k")
    few = big.join(skew.checked_broadcast(small), "k")
    many = big.join(skew.checked_broadcast(small, max_rows=5), "k")
    assert few.count() == many.count() == 10
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
