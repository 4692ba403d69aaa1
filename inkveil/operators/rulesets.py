"""Rule sets as data: a table of jobs with their own options, applied in one plan.

Documents find their job by a key, and jobs with equal options share a set.
The sets that most documents have are applied by Spark's own functions, each to
the documents it is for; all others, however many, share one pass in which
every row meets its own set's rules only.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.rules import BOX_MARK, LABEL_MARK, NO_RULES, Rule, build_rules, known_style
from inkveil.operators.redact import redact
from inkveil.operators.skew import BROADCAST_ROWS, checked_broadcast
from inkveil.plans.scratch import Staging, scratch_path

# Of a job beside its key; a missing column or a NULL means none, False or boxes.
OPTIONS = {
    "labels": "array<string>",
    "keywords": "array<string>",
    "expressions": "array<string>",
    "style": "string",
    "case_sensitive": "boolean",
    "whole_word": "boolean",
}
NATIVE_SETS = 24
MAX_SETS = 100_000
ROWS_PER_FILE = 100_000
_MATCHES = "array<struct<label:string,n:int>>"


@dataclass(frozen=True)
class RuleSet:
    """The options of a job as rules; ``error`` says why there are none."""

    number: int
    rules: tuple[Rule, ...]
    style: str
    error: str | None = None


def rule_set(number: int, options: dict) -> RuleSet:
    """One set; an invalid regex or an empty list of rules is an error of this set alone."""
    style = known_style(options.get("style"))
    lists = {name: [x for x in options.get(name) or () if x is not None] for name in ("labels", "keywords", "expressions")}
    flags = {name: bool(options.get(name)) for name in ("case_sensitive", "whole_word")}
    try:
        rules = build_rules(*lists.values(), **flags)
    except ValueError as cause:
        return RuleSet(number, (), style, str(cause))
    return RuleSet(number, tuple(rules), style, None if rules else NO_RULES)


class RuleSets:
    """The distinct rule sets of a table of jobs ``(key, options...)``.

    The driver holds the sets, at most ``MAX_SETS``; jobs stay a table.
    """

    def __init__(self, jobs: DataFrame, key: str = "run_id"):
        have = set(jobs.columns)
        options = [
            (F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)).alias(name)
            for name, kind in OPTIONS.items()
        ]
        keyed = jobs.select(F.col(key).alias(key), F.to_json(F.struct(*options)).alias("__options"))
        found = sorted(r["__options"] for r in keyed.select("__options").distinct().limit(MAX_SETS + 1).collect())
        if len(found) > MAX_SETS:
            raise ValueError(f"More than {MAX_SETS} different rule sets.")
        self.key = key
        self.sets = [rule_set(number, json.loads(text)) for number, text in enumerate(found)]
        numbers = jobs.sparkSession.createDataFrame(
            [(text, s.number, s.error) for text, s in zip(found, self.sets, strict=True)],
            "__options string, set_no int, error string",
        )
        self.jobs = keyed.join(F.broadcast(numbers), "__options").select(key, "set_no", "error")

    def refused(self) -> DataFrame:
        """``(key, error)`` of the jobs without usable rules."""
        return self.jobs.filter("error IS NOT NULL").select(self.key, "error")

    def redact(
        self,
        df: DataFrame,
        text: str = "text",
        into: str = "redacted",
        n_into: str = "n_redacted",
        matches_into: str | None = None,
        native_sets: int = NATIVE_SETS,
        broadcast_rows: int = BROADCAST_ROWS,
        staging: Staging | None = None,
    ) -> DataFrame:
        """``redact`` of every row by the rules and the style of its key's job.

        Rows whose job is unknown or refused are left out.  With one set there
        is nothing to deal; else rows are stored by set (each text is shuffled
        once, a set with a third of all rows to as many tasks as it needs) and
        each of the ``native_sets`` most frequent sets reads its own.
        """
        staging = staging or Staging(df.sparkSession)
        known = self.jobs.filter("error IS NULL").select(self.key, F.col("set_no").alias("__set"))
        rows = df.join(checked_broadcast(known, broadcast_rows), self.key)
        usable = {s.number: s for s in self.sets if s.error is None}
        names = (text, into, n_into, matches_into)
        if len(usable) < 2:
            only = next(iter(usable.values()), RuleSet(0, (), "box"))
            return redact(rows, only.rules, only.style, *names).drop("__set")
        counts = {r["__set"]: r["n"] for r in rows.groupBy("__set").agg(F.count("*").alias("n")).collect()}
        path = self._dealt(rows, counts, staging)
        often = sorted(counts, key=lambda k: (-counts[k], k))[:native_sets]
        read = df.sparkSession.read.schema(rows.drop("__set").schema)
        parts = [redact(read.parquet(f"{path}/__set={k}"), usable[k].rules, usable[k].style, *names) for k in often]
        rest = [usable[k] for k in counts if k not in set(often)]
        if rest or not parts:
            whole = df.sparkSession.read.schema(rows.schema).parquet(path)
            few = whole.filter(F.col("__set").isin([s.number for s in rest]) if rest else F.lit(False))
            parts.append(_each_its_own(few, rest, *names))
        return reduce(DataFrame.unionByName, parts)

    def _dealt(self, rows: DataFrame, counts: dict[int, int], staging: Staging) -> str:
        """The rows as a table with a folder per set; its path."""
        spark = rows.sparkSession
        path = scratch_path(spark, "sets")
        staging.paths.append(path)
        shares = spark.createDataFrame(
            [(k, -(-n // ROWS_PER_FILE)) for k, n in counts.items()], "__set int, __shares int"
        )
        placed = rows.withColumn("__id", F.monotonically_increasing_id()).join(F.broadcast(shares), "__set")
        placed = placed.withColumn("__share", F.pmod("__id", F.col("__shares")))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = placed.repartition(parts, "__set", "__share").select(*rows.columns)
        dealt.write.partitionBy("__set").parquet(path)
        return path


def _each_its_own(
    df: DataFrame, sets: Sequence[RuleSet], text: str, into: str, n_into: str, matches_into: str | None
) -> DataFrame:
    """Rows of many sets in one Arrow pass; a worker compiles the rules that its rows ask for."""
    plain = {s.number: (s.style, [(r.label, r.pattern, r.flags) for r in s.rules]) for s in sets}
    sweep = _own_rules(df.sparkSession.sparkContext.broadcast(plain), matches_into is not None)
    done = df.withColumn("__done", sweep(F.col(text), F.col("__set")))
    added = {into: F.col("__done.text"), n_into: F.coalesce("__done.n", F.lit(0))}
    if matches_into:
        added[matches_into] = F.coalesce("__done.matches", F.array().cast(_MATCHES))
    kept = [c for c in df.columns if c not in added and c != "__set"]
    return done.select(*kept, *[column.alias(name) for name, column in added.items()])


def _own_rules(shared: Broadcast, count: bool):
    """Arrow UDF: text and number of a set -> what its rules leave, the substitutions, and the matches before them."""
    box, label = BOX_MARK, LABEL_MARK
    kind = pa.struct(
        [("text", pa.string()), ("n", pa.int32()), ("matches", pa.list_(pa.struct([("label", pa.string()), ("n", pa.int32())])))]
    )

    def run(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        import re

        compiled: dict[int, tuple] = {}
        done = []
        for text, number in zip(texts.to_pylist(), numbers.to_pylist(), strict=True):
            if text is None:
                done.append(None)
                continue
            if number not in compiled:
                style, rules = shared.value[number]
                mark = label if style == "label" else (lambda m: box * (len(m[0]) or 1))
                compiled[number] = mark, [(name, re.compile(pattern, flags)) for name, pattern, flags in rules]
            mark, rules = compiled[number]
            hits = [(name, sum(1 for _ in p.finditer(text))) for name, p in rules] if count else []
            found: dict[str, int] = {}
            for name, n in hits:
                if n:
                    found[name] = found.get(name, 0) + n
            total = 0
            for _, pattern in rules:
                text, n = pattern.subn(mark, text)
                total += n
            done.append({"text": text, "n": total, "matches": [{"label": k, "n": n} for k, n in found.items()]})
        return pa.array(done, type=kind)

    return F.arrow_udf(run, f"text string, n int, matches {_MATCHES}").asNondeterministic()
