"""Detection: how often each rule matches the original text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.matching import (
    count_of,
    java_pattern,
    python_counts,
    sql_name,
    sql_text,
    with_clues,
)
from inkveil.functions.rules import Rule
from inkveil.plans.layout import with_small_batches


def merged(labels: Sequence[str], counts: Sequence[str]) -> dict[str, str]:
    """Label -> count expression in rule order, equal labels summed."""
    sums: dict[str, str] = {}
    for label, n in zip(labels, counts):
        sums[label] = f"{sums[label]} + {n}" if label in sums else n
    return sums


def count_list(labels: Sequence[str], counts: Sequence[str]) -> Column:
    """Ordered ``array<struct<label, n>>``, zeros left out."""
    pairs = [
        f"struct({sql_text(label)} AS label, {n} AS n)"
        for label, n in merged(labels, counts).items()
    ]
    if not pairs:
        return F.array().cast("array<struct<label:string,n:int>>")
    return F.expr(f"filter(array({', '.join(pairs)}), pair -> pair.n > 0)")


def with_counts(
    df: DataFrame, rules: Sequence[Rule], text: str = "text", engine: str = "auto"
) -> tuple[DataFrame, list[str]]:
    """``df`` plus one count column per rule, and the names of those columns."""
    source = f"coalesce({sql_name(text)}, '')"
    javas = [java_pattern(rule, engine) for rule in rules]
    slow = [rule for rule, java in zip(rules, javas) if java is None]
    work = with_clues(df, source, [r for r, java in zip(rules, javas) if java])
    if slow:
        work = with_small_batches(work).withColumn("__slow", python_counts(slow)(F.expr(source)))
    places = iter(range(len(slow)))
    counts = [
        f"__slow[{next(places)}]" if java is None else count_of(rule, java, source)
        for rule, java in zip(rules, javas)
    ]
    names = [f"__c{at}" for at in range(len(rules))]
    columns = [
        f"IF({sql_name(text)} IS NULL, 0, {count}) AS {name}" for count, name in zip(counts, names)
    ]
    return work.selectExpr("*", *columns), names


def detect(
    df: DataFrame,
    rules: Sequence[Rule],
    text: str = "text",
    into: str = "matches",
    engine: str = "auto",
) -> DataFrame:
    """Add ``into``: the list of (label, n) in rule order, labels with hits only."""
    work, counts = with_counts(df, rules, text, engine)
    kept = [c for c in df.columns if c != into]
    return work.select(*kept, count_list([r.label for r in rules], counts).alias(into))


def as_map(matches: Column) -> Column:
    """The match list as ``map<label, n>``."""
    return F.map_from_entries(matches)


def long_counts(df: DataFrame, keys: Sequence[str], matches: str = "matches") -> DataFrame:
    """One row per document and label.

    The outer form keeps the optimizer from testing the list for emptiness
    first, which would count every match twice.
    """
    return df.select(*keys, F.inline_outer(matches)).filter("label IS NOT NULL")


def summary_text(matches: Column) -> Column:
    """``label: n, label: n`` in rule order; empty when nothing matched."""
    return F.array_join(
        F.transform(matches, lambda m: F.concat(m["label"], F.lit(": "), m["n"].cast("string"))),
        ", ",
    )


def corpus_totals(
    df: DataFrame,
    rules: Sequence[Rule],
    by: Sequence[str],
    text: str = "text",
    engine: str = "auto",
) -> DataFrame:
    """Documents and matches per group and label, labels with hits only.

    Counts are summed as one wide row per group, so that a task ships at most
    one row per group and a large group costs no more than a small one.
    """
    work, counts = with_counts(df, rules, text, engine)
    sums = list(merged([r.label for r in rules], counts).items())
    work = work.selectExpr(*map(sql_name, by), *[f"{n} AS __n{i}" for i, (_, n) in enumerate(sums)])
    totals = work.groupBy(*by).agg(
        *[F.expr(f"sum(__n{i})").alias(f"__s{i}") for i in range(len(sums))],
        *[F.expr(f"count_if(__n{i} > 0)").alias(f"__d{i}") for i in range(len(sums))],
    )
    rows = [
        f"struct({i + 1} AS rule_no, {sql_text(label)} AS label,"
        f" __d{i} AS n_docs, __s{i} AS n_matches)"
        for i, (label, _) in enumerate(sums)
    ]
    listed = totals.selectExpr(*map(sql_name, by), f"inline(array({', '.join(rows)}))")
    return listed.filter("n_matches > 0")
