"""Output names without collisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.names import OUTPUT_ENDING, OUTPUT_SUFFIX, output_name, stem
from inkveil.operators.skew import GROUP, grouped, join_groups, running_total
from inkveil.plans.scratch import ensure_checkpoint_dir

# A number is one a name can carry: none (meaning 1), or 2 and up without leading
# zeros.  Numbers of 19 digits and more are no BIGINTs and out of any count's reach.
_TAKEN = rf"(?s)^(.*){OUTPUT_ENDING}(?:_([2-9]|[1-9][0-9]{{1,17}}))?\{OUTPUT_SUFFIX}\z"


def number_outputs(
    df: DataFrame,
    keys: Sequence[str] = (),
    name: str = "name",
    order: str = "seq",
    ok: str | None = None,
    existing: DataFrame | None = None,
    into: str = "number",
) -> DataFrame:
    """Number the outputs of each folder (``keys``) and stem, in ``order``.

    Only rows with ``ok`` take a number, so a failure leaves no gap; the
    others get NULL.  ``existing`` lists names already in the folder
    (``keys`` + ``output``): new outputs take the lowest numbers still free.
    """
    group = [*keys, "__stem"]
    good = F.lit(True) if ok is None else F.coalesce(F.col(ok), F.lit(False))
    rows = df.withColumns({"__stem": stem(F.col(name)), "__ok": good.cast("int")})
    rows = running_total(rows, group, order, "__ok", into="__nth")
    if existing is not None:
        rows = _beside(rows, group, existing)
    return rows.withColumn(into, F.when(F.col("__ok") == 1, F.col("__nth"))).select(*df.columns, into)


def _beside(rows: DataFrame, group: list[str], existing: DataFrame) -> DataFrame:
    """Move ``__nth`` past the numbers that are taken.

    Rows and taken numbers are stored (they are narrow, and read repeatedly).
    Names of stems that are not wanted are left out before any ranking, and
    groups without a taken name keep their numbers as they are.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    rows = grouped(rows, group).checkpoint()
    wanted = rows.filter("__ok = 1").select(GROUP).distinct()
    taken = grouped(_parsed(existing, group), group).join(wanted, GROUP, "left_semi")
    taken = taken.select(*group, "__number").distinct().checkpoint()
    full = grouped(taken, group).select(GROUP).distinct()
    moved = _skip_taken(rows.join(full, GROUP, "left_semi").drop(GROUP), group, _free_before(taken, group))
    moved = moved.withColumn("__nth", F.col("__nth") + F.coalesce("__skipped", F.lit(0))).drop("__skipped")
    return rows.join(full, GROUP, "left_anti").drop(GROUP).unionByName(moved)


def stem_of_output(output):
    """The stem that an output name was made of; empty if it is no output name."""
    return F.regexp_extract(output, _TAKEN, 1)


def _parsed(existing: DataFrame, group: Sequence[str]) -> DataFrame:
    """Names in the folder as (keys, __stem, __number)."""
    output = F.col("output")
    digits = F.nullif(F.regexp_extract(output, _TAKEN, 2), F.lit(""))
    return existing.filter(output.rlike(_TAKEN)).select(
        *group[:-1],
        stem_of_output(output).alias("__stem"),
        F.coalesce(digits.cast("bigint"), F.lit(1)).alias("__number"),
    )


def _free_before(taken: DataFrame, group: Sequence[str]) -> DataFrame:
    """(keys, __stem, __free, __taken): how many names are taken after that many free ones."""
    ranked = running_total(taken, group, "__number", into="__rank")
    free = (F.col("__number") - F.col("__rank")).alias("__free")
    return ranked.groupBy(*group, free).agg(F.count("*").alias("__taken")).checkpoint()


def _skip_taken(rows: DataFrame, group: list[str], taken: DataFrame) -> DataFrame:
    """Add ``__skipped``: taken numbers below the n-th free one.

    Taken and wanted numbers are put in one order (a taken one with f free
    ones below it comes before the wanted one f + 1), where a running total
    counts the taken ones.
    """
    wanted = rows.filter("__ok = 1").select(
        *group,
        (F.col("__nth") * 2).alias("__place"),
        F.lit(0).cast("bigint").alias("__taken"),
        F.col("__nth").alias("__want"),
    )
    gone = taken.select(
        *group,
        (F.col("__free") * 2 + 1).alias("__place"),
        "__taken",
        F.lit(None).cast("bigint").alias("__want"),
    )
    # Stored, as running totals read their input several times.
    line = wanted.unionByName(gone).checkpoint()
    placed = running_total(line, group, "__place", "__taken", "__skipped")
    skipped = placed.filter("__want IS NOT NULL").select(
        *group, F.col("__want").alias("__nth"), "__skipped"
    )
    return join_groups(rows, skipped, [*group, "__nth"]).withColumn(
        "__skipped", F.when(F.col("__ok") == 1, F.col("__skipped"))
    )


def output_names(
    df: DataFrame,
    keys: Sequence[str] = (),
    name: str = "name",
    order: str = "seq",
    ok: str | None = None,
    existing: DataFrame | None = None,
    into: str = "output",
) -> DataFrame:
    """Add the output name; empty for rows that are not ``ok``."""
    numbered = number_outputs(df, keys, name, order, ok, existing, "__number")
    named = output_name(stem(F.col(name)), F.col("__number"))
    return numbered.withColumn(into, F.coalesce(named, F.lit(""))).drop("__number")
