"""The list of inputs: which entries count, under which name, with which bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.names import safe_name
from inkveil.operators.skew import GROUP, grouped, spread_lookup
from inkveil.plans.scratch import ensure_checkpoint_dir

VALUE_BITS = 12
# Messages.
NO_FILES = "No files uploaded."
NO_VALID_FILES = "No valid files uploaded."


def drop_unnamed(df: DataFrame, name: str = "name") -> DataFrame:
    """Leave out entries without a name."""
    return df.filter(F.col(name).isNotNull() & (F.col(name) != ""))


def with_safe_names(df: DataFrame, name: str = "name", into: str = "safe_name") -> DataFrame:
    """Add the safe form of the name; entries left without one are dropped."""
    return df.withColumn(into, safe_name(F.col(name))).filter(F.col(into) != "")


def require_inputs(df: DataFrame, message: str = NO_FILES) -> DataFrame:
    """``df`` unless it is empty (stops at the first row found)."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def input_manifest(df: DataFrame, name: str = "name", into: str = "safe_name") -> DataFrame:
    """Named entries under their safe names."""
    return with_safe_names(drop_unnamed(df, name), name, into)


def last_write_wins(
    df: DataFrame,
    keys: Sequence[str] = ("name",),
    order: str = "seq",
    values: Sequence[str] = ("content",),
) -> DataFrame:
    """Every entry stays listed, with the values of the last entry of its name.

    The winner is found on (name, order) alone, combined before the shuffle;
    its values are fetched by (name, order), which no name can make hot.
    Entries with a NULL name have each other's values.  The winner's values
    are copied to blocks of ``2**VALUE_BITS`` order values: values are wide.
    """
    last = df.groupBy(*keys).agg(F.max(order).alias(order))
    winners = _only(df.select(*keys, order, *values), last, [*keys, order]).drop(order)
    others = [c for c in df.columns if c not in values]
    return spread_lookup(df.select(*others), winners, keys, order, VALUE_BITS).select(*df.columns)


def dedup_inputs(
    df: DataFrame, keys: Sequence[str] = ("name", "size"), order: str = "seq"
) -> DataFrame:
    """Keep the first entry of equal name and size; a NULL equals a NULL.

    Same shape as above: the minimum is combined before the shuffle, and the
    semi join is spread over the order values.
    """
    first = df.groupBy(*keys).agg(F.min(order).alias(order))
    return _only(df, first, [*keys, order])


def _only(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are in ``wanted``; compared as one struct, so NULLs meet, too."""
    return grouped(df, keys).join(grouped(wanted, keys).select(GROUP), GROUP, "left_semi").select(*df.columns)


def number_inputs(df: DataFrame, *order_by: str, into: str = "seq") -> DataFrame:
    """Add a unique number that grows along ``order_by``.

    The sort is by ranges of the full order, so equal names do not pile up.
    The numbers depend on where the ranges fall, hence the stored result.
    Meant for narrow listings.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.orderBy(*order_by).withColumn(into, F.monotonically_increasing_id()).checkpoint()
