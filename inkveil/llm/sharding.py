"""Sharding: a uniform shuffle with exact shard sizes by a communication matrix.

Rows are dealt to partitions by a hash.  How many rows of each partition go to
each shard is drawn from the multivariate hypergeometric distribution, which is
how the counts fall out in a uniform shuffle of all rows into shards of fixed
sizes.  Then every partition permutes its own rows and hands them out by its
line of the matrix, and every shard permutes what it got.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_PARTITION = 20_000
MOST_PARTITIONS = 1 << 16  # the matrix, and so what the driver holds, ends there


def hypergeometric(draw: random.Random, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` rows taken from ``good + bad`` are good, drawn exactly.

    Inversion from the mode outwards: as many steps as the draw is away from
    it, whatever the numbers' size.
    """
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma

    def choose(n: int, k: int) -> float:
        return lg(n + 1) - lg(k + 1) - lg(n - k + 1)

    peak = math.exp(choose(good, mode) + choose(bad, sample - mode) - choose(good + bad, sample))
    left = draw.random() - peak
    up, down, p_up, p_down = mode, mode, peak, peak
    while left > 0:
        p_up *= (good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1)) if up < high else 0
        p_down *= down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1)) if down > low else 0
        if p_up < 1e-300 and p_down < 1e-300:
            return mode  # what rounding has left of the unit interval
        up, down = min(up + 1, high), max(down - 1, low)
        if p_up and (left := left - p_up) <= 0:
            return up
        if p_down and (left := left - p_down) <= 0:
            return down
    return mode


def communication_matrix(
    counts: Sequence[int], sizes: Sequence[int], seed: int
) -> list[list[int]]:
    """Rows of partition i for shard j; lines sum to ``counts``, columns to ``sizes``."""
    rest, matrix = list(sizes), []
    for i, count in enumerate(counts):
        draw, line, pool = random.Random(f"{seed}/{i}"), [], sum(rest)
        for j in range(len(rest)):
            pool -= rest[j]
            n = hypergeometric(draw, rest[j], pool, count)
            line.append(n)
            count -= n
            rest[j] -= n
        matrix.append(line)
    return matrix


def even_sizes(rows: int, shards: int) -> list[int]:
    """Shard sizes at most one apart, the larger ones first."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def _place(keys: Sequence[str], seed: int, salt: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(salt), *[F.col(k) for k in keys])


def shuffle_to_shards(
    df: DataFrame, keys: Sequence[str], shards: int, seed: int = 0, sizes: Sequence[int] | None = None
) -> DataFrame:
    """Add ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard); all columns are kept.

    ``keys`` tell rows apart; rows alike in all of them are dealt in any order,
    which no result shows if the other columns are alike, too.  NULL keys hash
    like a value.  ``sizes`` are the shards' exact sizes (default: at most one
    apart).  Columns named ``shard`` and ``slot`` are replaced; an empty table
    stays empty.  Reruns agree.

    The rows are shuffled twice, evenly by hash; windows hold about
    ``ROWS_PER_PARTITION`` rows.  The driver holds the matrix alone.
    """
    df = df.drop("shard", "slot")
    total = df.count()
    sizes = even_sizes(total, shards) if sizes is None else list(sizes)
    if sum(sizes) != total:
        raise ValueError(f"The shards hold {sum(sizes)} rows, the table {total}.")
    parts = min(MOST_PARTITIONS, max(64, -(-total // ROWS_PER_PARTITION)))
    dealt = df.withColumn("__part", F.pmod(_place(keys, seed, 1), F.lit(parts)).cast("int"))
    found = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}
    order = sorted(found)
    matrix = communication_matrix([found[p] for p in order], sizes, seed)

    # A partition's line as one array of running sums, by partition number.
    lines = {p: line for p, line in zip(order, matrix, strict=True)}
    starts = [[sum(lines[p][:j]) if p in lines else 0 for j in range(shards)] for p in range(parts)]
    table = df.sparkSession.sql(
        "SELECT * FROM VALUES "
        + ", ".join(f"({p}, array({', '.join(f'{x}L' for x in s)}))" for p, s in enumerate(starts))
        + " AS t(__part, __starts)"
    )
    own = Window.partitionBy("__part").orderBy(_place(keys, seed, 2), *keys)
    handed = (
        dealt.withColumn("__rank", F.row_number().over(own) - 1)
        .join(F.broadcast(table), "__part")
        .withColumn(
            "shard",
            (F.size(F.filter("__starts", lambda s: s <= F.col("__rank"))) - 1).cast("int"),
        )
        .withColumn("__bin", F.pmod(_place(keys, seed, 3), F.lit(parts)).cast("int"))
    )
    return _permuted(handed, keys, seed, parts).select(*df.columns, "shard", "slot")


def _permuted(handed: DataFrame, keys: Sequence[str], seed: int, parts: int) -> DataFrame:
    """The second permutation: slots by (bin, hash), numbered bin by bin."""
    bins = handed.groupBy("shard", "__bin").count()
    before = Window.partitionBy("shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bins.select(
        "shard", "__bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before")
    )
    own = Window.partitionBy("shard", "__bin").orderBy(_place(keys, seed, 4), *keys)
    ranked = handed.withColumn("__rank", F.row_number().over(own) - 1)
    return ranked.join(offsets, ["shard", "__bin"]).withColumn(
        "slot", (F.col("__before") + F.col("__rank")).cast("bigint")
    )


def op6_shards(docs: DataFrame, shards: int = 8, seed: int = 20) -> DataFrame:
    """The contract's columns under the law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        (F.length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = shuffle_to_shards(rows, ["doc_id", "size", "text_crc32"], shards, seed)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
