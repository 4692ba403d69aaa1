import math
import random
from collections import Counter

import pytest

from inkveil.llm.sharding import communication_matrix, hypergeometric, op6_shards, shuffle_to_shards
from tests.llm.edge import empty, frame


@pytest.mark.parametrize("good,bad,sample", [(5, 7, 4), (1, 9, 5), (30, 2, 20), (0, 5, 3), (6, 0, 2)])
def test_draws_follow_the_distribution(good, bad, sample):
    rng, n = random.Random(1), 4000
    seen = Counter(hypergeometric(rng, good, bad, sample) for _ in range(n))
    for k in range(sample + 1):
        p = math.comb(good, k) * math.comb(bad, sample - k) / math.comb(good + bad, sample)
        assert abs(seen[k] / n - p) < 4 * math.sqrt(max(p * (1 - p), 1e-4) / n)


def test_draws_of_large_numbers():
    rng = random.Random(2)
    draws = [hypergeometric(rng, 4 * 10**9, 28 * 10**9, 10**7) for _ in range(50)]
    assert all(abs(d - 1.25e6) < 6 * 1046 for d in draws) and len(set(draws)) > 40


def test_matrix_sums():
    counts, sizes = [7, 0, 120, 33], [40, 40, 40, 40]
    matrix = communication_matrix(counts, sizes, 3)
    assert [sum(line) for line in matrix] == counts
    assert [sum(c) for c in zip(*matrix)] == sizes


def test_exact_sizes_gapless_slots_and_reruns(spark):
    df = spark.range(1003).selectExpr("id", "id % 3 AS extra").repartition(5)
    got = shuffle_to_shards(df, ["id"], 8, seed=5)
    rows = got.collect()
    sizes = Counter(r["shard"] for r in rows)
    assert sorted(sizes.values()) == [125] * 5 + [126] * 3
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    assert sorted(r["id"] for r in rows) == list(range(1003))
    again = shuffle_to_shards(df.repartition(2), ["id"], 8, seed=5).collect()
    assert sorted(rows) == sorted(again)
    other = shuffle_to_shards(df, ["id"], 8, seed=6).collect()
    assert sorted(rows) != sorted(other)


def test_given_sizes(spark):
    got = shuffle_to_shards(spark.range(10), ["id"], 3, sizes=[7, 0, 3]).groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in got} == {0: 7, 2: 3}
    with pytest.raises(ValueError):
        shuffle_to_shards(spark.range(10), ["id"], 2, sizes=[1, 2])


def test_uniform(spark):
    """Every row meets every shard alike: chi-square over many seeds."""
    seen = Counter()
    df = spark.range(12)
    for seed in range(40):
        seen.update((r["id"], r["shard"]) for r in shuffle_to_shards(df, ["id"], 3, seed).collect())
    expected = 40 / 3
    assert sum((seen[i, s] - expected) ** 2 / expected for i in range(12) for s in range(3)) < 60


def test_edges(spark):
    docs = frame(spark)
    got = op6_shards(docs)
    assert got.count() == docs.count()
    rows = got.collect()
    assert {r["law"] for r in rows} == {"rows"} and all(r["grown_shard"] is None for r in rows)
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes[s] for s in range(8)) <= 1
    assert sum(r["size"] for r in rows) == sum(1 + len((r["text"] or "").encode()) for r in docs.collect())
    whole = shuffle_to_shards(docs, ["doc_id", "text"], 2)
    assert sorted(whole.columns) == sorted(docs.columns) and whole.count() == docs.count()
    assert op6_shards(empty(spark)).count() == 0
