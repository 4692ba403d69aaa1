"""Numbering, running totals and lookups that survive a hot key.

A group may hold a third of all rows, so nothing here sorts or collects a
whole group in one task.  Rows are grouped into blocks of consecutive order
values (``order >> 21``); a block holds at most 2**21 rows of distinct order,
and the totals of the blocks are themselves summed in blocks.  Two such levels
bound every sort at 2**22 rows for any BIGINT order column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.plans.scratch import ensure_checkpoint_dir

GROUP = "__group"
BLOCK_BITS = 21
LEVELS = 2
BROADCAST_ROWS = 1_000_000


def block_of(order: str, bits: int | None = None):
    """The block an order value falls into; grows with the order."""
    return F.shiftright(F.col(order).cast("bigint"), BLOCK_BITS if bits is None else bits)


def grouped(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the keys as one struct, which is never NULL and equal to itself.

    Joining on it keeps rows with NULL keys, and reuses the partitioning of a
    window over it, where a null-safe comparison would shuffle once more.
    """
    return df.withColumn(GROUP, F.struct(*keys))


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Give every row the columns of its group; NULL keys form a group, too."""
    right = grouped(groups, keys).drop(*keys)
    return grouped(rows, keys).join(right, GROUP, "left").drop(GROUP)


def _with_earlier(df: DataFrame, order: str, weight: str, level: int) -> DataFrame:
    """Add the weight of the group before each row and in all."""
    earlier, total = f"__earlier{level}", f"__total{level}"
    if level == 0:
        group = Window.partitionBy(GROUP)
        before = group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns(
            {
                earlier: F.coalesce(F.sum(weight).over(before), F.lit(0)),
                total: F.sum(weight).over(group),
            }
        )
    block, in_block = f"__block{level}", f"__weight{level}"
    rows = df.withColumn(block, block_of(order))
    blocks = rows.groupBy(GROUP, block).agg(F.sum(weight).alias(in_block))
    placed = _with_earlier(blocks, block, in_block, level - 1).select(
        GROUP,
        block,
        F.col(f"__earlier{level - 1}").alias("__before_block"),
        F.col(f"__total{level - 1}").alias(total),
    )
    before = (
        Window.partitionBy(GROUP, block)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = rows.withColumn("__in_block", F.coalesce(F.sum(weight).over(before), F.lit(0)))
    return (
        local.join(placed, [GROUP, block], "left")
        .withColumn(earlier, F.col("__before_block") + F.col("__in_block"))
        .drop(block, "__before_block", "__in_block")
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    weight: str | None = None,
    into: str = "position",
    total_into: str | None = None,
) -> DataFrame:
    """Add the running sum of ``weight`` (default: 1 per row) up to and with each row.

    ``order`` is a BIGINT without repeats inside a group.  ``df`` is read twice
    (rows, and totals of blocks) and its rows are shuffled once, so pass narrow
    or stored data.
    """
    weight = F.lit(1) if weight is None else F.col(weight).cast("bigint")
    work = _with_earlier(grouped(df, keys).withColumn("__weight", weight), order, "__weight", LEVELS)
    added = {into: F.col(f"__earlier{LEVELS}") + F.col("__weight")}
    if total_into:
        added[total_into] = F.col(f"__total{LEVELS}")
    return work.withColumns(added).select(*df.columns, *added)


def spread_lookup(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], order: str, bits: int | None = None
) -> DataFrame:
    """Give every row its group's columns without bringing a hot group together.

    ``groups`` has one row per key.  Its rows are first copied to the blocks of
    ``2**bits`` order values in which their key occurs, then joined block by
    block.  Wide values want small blocks: a block's rows meet in one task.
    """
    blocked = grouped(rows, keys).withColumn("__block", block_of(order, bits))
    places = blocked.select(GROUP, "__block").distinct()
    spread = places.join(grouped(groups, keys).drop(*keys), GROUP, "left")
    return blocked.join(spread, [GROUP, "__block"], "left").drop(GROUP, "__block")


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Store ``df``, count it, and mark it for broadcast only if it is small.

    Beyond ``max_rows`` the join that uses it is an ordinary shuffle join.  The
    checkpoint goes with the DataFrame where the session's cleaner is on.
    """
    ensure_checkpoint_dir(df.sparkSession)
    stored = df.checkpoint()
    return F.broadcast(stored) if stored.count() <= max_rows else stored
