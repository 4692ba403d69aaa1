"""Redaction: ordered rewrites, each rule seeing the text its predecessors left."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.arrow_pass import arrow_chain, arrow_redact
from inkveil.functions.matching import (
    count_of,
    hits_in,
    java_pattern,
    marked,
    python_counts,
    python_rewrite,
    rewritten,
    sql_name,
    with_clues,
)
from inkveil.functions.rules import Rule, known_style
from inkveil.operators.detect import count_list
from inkveil.plans.layout import with_small_batches


def redact(
    df: DataFrame,
    rules: Sequence[Rule],
    style: str = "box",
    text: str = "text",
    into: str = "redacted",
    n_into: str = "n_redacted",
    matches_into: str | None = None,
    engine: str = "auto",
) -> DataFrame:
    """Add the redacted text and the number of substitutions.

    ``matches_into`` also adds the match list on the *original* text (see
    ``detect``); a rule's hits serve for it as long as nothing was rewritten.
    A NULL text stays NULL with count 0.

    Rules that can all be spelled for Arrow's regexes are one pass over Arrow
    batches.  Otherwise every native rule makes one regex pass over a text; the
    rest is cutting and joining, and only where there was a hit.  Rules that
    need Python and stand together share one Arrow UDF.  No shuffle takes place.
    """
    style = known_style(style)
    original = f"coalesce({sql_name(text)}, '')"
    if chain := arrow_chain(rules, engine):
        done = arrow_redact(chain, style, matches_into is not None)(F.col(text))
        work = with_small_batches(df).withColumn("__done", done)
        work = work.withColumns({"__t": F.col("__done.text"), "__n": F.col("__done.n")})
        return _finished(df, work, rules, text, into, n_into, matches_into, [f"__done.counts[{i}]" for i in range(len(rules))])
    javas = [java_pattern(rule, engine) for rule in rules]
    work = with_clues(df, original, [r for r, java in zip(rules, javas) if java is not None])
    work = work.withColumns({"__t": F.expr(original), "__n": F.lit(0)})
    counts: list[str] = []

    for needs_python, members in groupby(zip(rules, javas), key=lambda pair: pair[1] is None):
        pairs = list(members)
        step = _python_step if needs_python else _native_step
        work, found = step(work, pairs, style, original if matches_into else None, len(counts))
        counts += found

    return _finished(df, work, rules, text, into, n_into, matches_into, counts)


def _finished(
    df: DataFrame,
    work: DataFrame,
    rules: Sequence[Rule],
    text: str,
    into: str,
    n_into: str,
    matches_into: str | None,
    counts: list[str],
) -> DataFrame:
    """The columns of ``redact`` from ``__t``, ``__n`` and a count per rule."""
    null = F.col(text).isNull()
    added = {into: F.when(~null, F.col("__t")), n_into: F.when(null, 0).otherwise(F.col("__n"))}
    if matches_into:
        found = count_list([r.label for r in rules], counts)
        added[matches_into] = F.filter(found, lambda pair: ~null)
    kept = [c for c in df.columns if c not in added]
    return work.select(*kept, *[column.alias(name) for name, column in added.items()])


def _native_step(
    work: DataFrame,
    pairs: list[tuple[Rule, str]],
    style: str,
    original: str | None,
    first: int,
) -> tuple[DataFrame, list[str]]:
    """Rules in a row as one select whose columns build on each other."""
    columns, counts = [], []
    t, n = "__t", "__n"
    for at, (rule, java) in enumerate(pairs, start=first):
        mark = f"__m{at}"
        found = hits_in(rule, java, style, mark, t)
        columns.append(f"{marked(rule, java, style, t)} AS {mark}")
        columns.append(f"IF({found} = 0, {t}, {rewritten(java, style, t, mark)}) AS __t{at}")
        columns.append(f"{n} + {found} AS __n{at}")
        if original is not None:
            again = count_of(rule, java, original)
            columns.append(f"IF({n} = 0, {found}, {again}) AS __c{at}")
            counts.append(f"__c{at}")
        t, n = f"__t{at}", f"__n{at}"
    work = work.selectExpr("*", *columns).drop("__t", "__n")
    return work.withColumnsRenamed({t: "__t", n: "__n"}), counts


def _python_step(
    work: DataFrame,
    pairs: list[tuple[Rule, None]],
    style: str,
    original: str | None,
    first: int,
) -> tuple[DataFrame, list[str]]:
    """Rules in a row as one Arrow UDF."""
    rules = [rule for rule, _ in pairs]
    work = with_small_batches(work)
    if original is not None:
        work = work.withColumn(f"__p{first}", python_counts(rules)(F.expr(original)))
    work = work.withColumn("__done", python_rewrite(rules, style)(F.col("__t")))
    work = work.withColumns({"__t": F.col("__done.text"), "__n": F.expr("__n + __done.n")})
    return work, [f"__p{first}[{i}]" for i in range(len(rules))]
