"""Run tables: results, summary, progress, activity, expiry, lookup.

A run is a set of files: ``(run_id, seq, input, output, ok)`` per file, and
``(run_id, created, status, error)`` per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.operators.detect import summary_text
from inkveil.operators.skew import running_total

# Lifetime of a run and wording.  The sentences of status_sentence and
# run_outcome and the lines of activity_log are fixed wording, too.
RUN_TTL_SECONDS = 3600
UNKNOWN_RUN = "Unknown or expired job."
UNKNOWN_ERROR = "unknown error"


def run_results(files: DataFrame) -> DataFrame:
    """One row per file; ``output`` is empty where the file failed."""
    ok = F.col("error").isNull()
    return files.select(
        "run_id",
        "seq",
        F.col("name").alias("input"),
        F.when(ok, F.col("output")).otherwise("").alias("output"),
        ok.alias("ok"),
    )


def status_sentence(n_ok: Column, n_failed: Column) -> Column:
    """One sentence on how a finished run went."""
    good, bad = n_ok.cast("string"), n_failed.cast("string")
    files = F.when(n_ok == 1, F.lit(" file redacted.")).otherwise(F.lit(" files redacted."))
    mixed = F.concat(F.lit("Done — "), good, F.lit(" succeeded, "), bad, F.lit(" failed."))
    return F.when(n_failed > 0, mixed).otherwise(F.concat(F.lit("Done — "), good, files))


def run_summary(results: DataFrame) -> DataFrame:
    """Files that worked and failed per run, and the sentence about it."""
    counted = results.groupBy("run_id").agg(
        F.count_if(F.col("ok")).alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed")
    )
    return counted.withColumn("sentence", status_sentence(F.col("n_ok"), F.col("n_failed")))


def run_outcome(runs: DataFrame, results: DataFrame) -> DataFrame:
    """The sentence per run, also for runs that broke off as a whole."""
    failed = F.concat(F.lit("Job failed: "), F.coalesce(F.col("error"), F.lit(UNKNOWN_ERROR)))
    sentence = F.when(F.col("status") == "error", failed).when(
        F.col("status") == "done",
        status_sentence(F.coalesce("n_ok", F.lit(0)), F.coalesce("n_failed", F.lit(0))),
    )
    joined = runs.join(run_summary(results).drop("sentence"), "run_id", "left")
    return joined.select(*runs.columns, sentence.alias("sentence"))


def run_progress(results: DataFrame) -> DataFrame:
    """Where a run stands after each file: current, total, rounded percent."""
    counted = running_total(results, ["run_id"], "seq", into="current", total_into="total")
    return counted.withColumn(
        "percent", F.floor(F.col("current") / F.col("total") * 100 + 0.5).cast("int")
    )


def activity_log(files: DataFrame, total: str | None = None) -> DataFrame:
    """The lines a run writes per file, as rows ``(run_id, seq, line_no, line)``.

    ``files``: ``(run_id, seq, name, output, error, accepted, matches, n_redacted)``.
    ``total`` names a column with the run's number of files, if not all are there yet.
    """
    name, failed = F.col("name"), F.col("error").isNotNull()
    detected = summary_text(F.col("matches"))
    preview_failed = failed & F.col("accepted")
    line = F.when(
        detected != "", F.concat(F.lit("  Detected -> "), detected)
    ).otherwise(F.lit("  No matches in preview (Markdown export still runs)."))
    lines = F.array(
        F.format_string("[%d/%d] Scanning %s...", "current", "total", name),
        F.when(preview_failed, F.format_string("  (preview failed for %s: %s)", name, "error")),
        line,
        F.format_string("  Redacting %s...", name),
        F.when(failed, F.format_string("  ERROR redacting %s: %s", name, "error")).otherwise(
            F.format_string("  MARKDOWN: %d match(es) redacted.", "n_redacted")
        ),
        F.when(failed, F.concat(F.lit("  FAILED: "), "error")).otherwise(
            F.concat(F.lit("  Saved -> "), "output")
        ),
    )
    # Texts are not needed, so they are not read.
    columns = ["run_id", "seq", "name", "output", "error", "accepted", "matches", "n_redacted"]
    narrow = files.select(*columns, *([F.col(total).alias("__files")] if total else []))
    placed = running_total(narrow, ["run_id"], "seq", into="current", total_into="total")
    if total:
        placed = placed.withColumn("total", F.col("__files"))
    written = placed.select("run_id", "seq", F.posexplode(F.array_compact(lines)))
    return written.select(
        "run_id", "seq", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line")
    )


def expire_runs(runs: DataFrame, now, ttl_seconds: int = RUN_TTL_SECONDS) -> DataFrame:
    """Runs still alive at ``now`` (a timestamp or column); the cutoff itself is alive."""
    moment = now if isinstance(now, Column) else F.lit(now)
    return runs.filter(F.col("created") >= moment - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def find_run(runs: DataFrame, run_id) -> DataFrame:
    """The rows of one run, possibly none."""
    return runs.filter(F.col("run_id") == F.lit(run_id))


def require_run(runs: DataFrame, run_id) -> DataFrame:
    """The rows of one run; an unknown one is an error."""
    found = find_run(runs, run_id)
    if found.isEmpty():
        raise LookupError(UNKNOWN_RUN)
    return found
