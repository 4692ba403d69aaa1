"""From a table of files to redacted documents, names and run tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkveil.functions.names import accepted, output_name, stem
from inkveil.functions.rules import Rule
from inkveil.operators.detect import detect
from inkveil.operators.ledger import activity_log, run_progress, run_results, run_summary
from inkveil.operators.naming import number_outputs
from inkveil.operators.redact import redact
from inkveil.operators.rulesets import RuleSets
from inkveil.operators.skew import BROADCAST_ROWS, checked_broadcast
from inkveil.plans.scratch import Staging
from inkveil.sources.extract import Extractor, extract
from inkveil.sources.outputs import by_run

NO_MATCHES = "CAST(array() AS array<struct<label:string,n:int>>)"
KEYS = ["run_id", "seq"]


def _extracted(
    files: DataFrame, extractors: Mapping[str, Extractor] | None, staging: Staging
) -> DataFrame:
    """Files with text and error.

    Work done by caller-supplied code is stored at once: later steps read it
    more than once, and a lost executor must not run it all over again.
    """
    work = extract(files, extractors).withColumn("accepted", accepted(F.col("name")))
    work = work.drop("content")
    return staging.store(work, "extracted") if extractors else work


def preview_sources(
    files: DataFrame,
    rules: Sequence[Rule],
    extractors: Mapping[str, Extractor] | None = None,
    engine: str = "auto",
) -> DataFrame:
    """Add ``matches``: what each source would have redacted, nothing for unreadable ones.

    Sources whose suffix is not accepted are not opened.
    """
    opened = accepted(F.col("name"))
    gated = files.withColumn("content", F.when(opened, F.col("content")))
    texts = extract(gated, extractors).withColumn("error", F.when(opened, F.col("error")))
    return detect(texts, rules, engine=engine).drop("content", "text")


def redact_sources(
    files: DataFrame,
    rules: Sequence[Rule] | RuleSets,
    style: str = "box",
    extractors: Mapping[str, Extractor] | None = None,
    existing: DataFrame | None = None,
    engine: str = "auto",
    broadcast_rows: int = BROADCAST_ROWS,
    staging: Staging | None = None,
) -> DataFrame:
    """Extract, detect, redact and name ``(run_id, seq, name, content)``.

    Returns ``(run_id, seq, name, output, error, accepted, matches,
    n_redacted, markdown)``; a source that cannot be read is a row with an
    error and no output.

    The documents themselves are never shuffled unless they have to be: names
    are numbered on (run, seq, name) alone, and only the numbers beyond 1 are
    joined back: by broadcast up to ``broadcast_rows``, by a shuffle beyond.
    With ``RuleSets`` every run has its own rules and style (and texts are
    dealt by set, if there are several); ``style`` and ``engine`` then say nothing.
    What ``staging`` holds may be cleared once the result is stored.
    """
    staging = staging or Staging(files.sparkSession)
    work = _extracted(files, extractors, staging)
    return _redacted(work, _numbered(work, existing, broadcast_rows), rules, style, engine, broadcast_rows, staging)


def redact_in_slices(
    files: DataFrame,
    rules: Sequence[Rule] | RuleSets,
    slices: int,
    style: str = "box",
    extractors: Mapping[str, Extractor] | None = None,
    staging: Staging | None = None,
) -> Iterator[DataFrame]:
    """``redact_sources`` in ``slices`` parts, one after the other; a run's files come in the order of ``seq``.

    Names are numbered once over all files.  Each part works on its own files
    only, so whoever stores the parts as they come can tell how far a run is.
    """
    staging = staging or Staging(files.sparkSession)
    work = _extracted(files, extractors, staging)
    beyond = _numbered(work, None, BROADCAST_ROWS)
    if slices < 2:
        yield _redacted(work, beyond, rules, style, "auto", BROADCAST_ROWS, staging)
        return
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    bounds = work.groupBy("run_id").agg(F.percentile_approx("seq", shares, F.lit(10_000)).alias("__bounds"))
    placed = work.join(checked_broadcast(bounds), "run_id")
    placed = placed.withColumn("__slice", F.size(F.filter("__bounds", lambda b: b < F.col("seq")))).drop("__bounds")
    for number in range(slices):
        part = placed.filter(F.col("__slice") == number).drop("__slice")
        yield _redacted(part, beyond, rules, style, "auto", BROADCAST_ROWS, staging)


def _numbered(work: DataFrame, existing: DataFrame | None, broadcast_rows: int) -> DataFrame:
    """``(run_id, seq, number)`` of the outputs that need a number in their name."""
    narrow = work.select(*KEYS, "name", F.col("error").isNull().alias("ok"))
    numbers = number_outputs(narrow, ["run_id"], ok="ok", existing=existing)
    return checked_broadcast(numbers.filter("number > 1").select(*KEYS, "number"), broadcast_rows)


def _redacted(
    work: DataFrame,
    beyond: DataFrame,
    rules: Sequence[Rule] | RuleSets,
    style: str,
    engine: str,
    broadcast_rows: int,
    staging: Staging,
) -> DataFrame:
    if isinstance(rules, RuleSets):
        done = rules.redact(work, into="markdown", matches_into="matches", broadcast_rows=broadcast_rows, staging=staging)
    else:
        done = redact(work, rules, style, matches_into="matches", into="markdown", engine=engine)
    good = F.col("error").isNull()
    name = output_name(stem(F.col("name")), F.coalesce("number", F.lit(1)))
    return done.join(beyond, KEYS, "left").select(
        *KEYS,
        "name",
        F.when(good, name).otherwise("").alias("output"),
        "error",
        "accepted",
        F.when(F.col("accepted"), F.col("matches")).otherwise(F.expr(NO_MATCHES)).alias("matches"),
        F.when(good, F.col("n_redacted")).otherwise(0).alias("n_redacted"),
        "markdown",
    )


@dataclass(frozen=True)
class RunTables:
    """The tables a run leaves behind, all derived from its stored documents."""

    documents: DataFrame

    @property
    def results(self) -> DataFrame:
        return run_results(self.documents)

    @property
    def summary(self) -> DataFrame:
        return run_summary(self.results)

    @property
    def progress(self) -> DataFrame:
        return run_progress(self.results)

    @property
    def activity(self) -> DataFrame:
        return activity_log(self.documents)


def store_run(
    documents: DataFrame, path: str, staging: Staging | None = None, mode: str = "overwrite"
) -> RunTables:
    """Write the documents of ``redact_sources`` once and derive everything from the table.

    The table has a folder per run, so one run is found without reading the
    others; runs already there are kept, or replaced if they are written again.
    With ``mode="append"`` the documents are added to those of their runs.
    """
    writer = by_run(documents).write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").parquet(path)
    if staging is not None:
        staging.clear()
    return stored_run(documents.sparkSession, path, documents.schema)


def stored_run(spark: SparkSession, path: str, schema: StructType | str) -> RunTables:
    """The tables of runs that ``store_run`` wrote."""
    return RunTables(spark.read.schema(schema).parquet(path))
