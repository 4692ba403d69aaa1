"""Submitted jobs: a listing of files in, stored documents and a run row out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkveil.functions.rules import Rule
from inkveil.operators.ledger import RUN_TTL_SECONDS, activity_log, expire_runs, run_outcome, run_summary
from inkveil.operators.manifest import (
    NO_FILES,
    NO_VALID_FILES,
    drop_unnamed,
    last_write_wins,
    require_inputs,
    with_safe_names,
)
from inkveil.operators.rulesets import RuleSets
from inkveil.operators.skew import running_total
from inkveil.plans.run import RunTables, redact_in_slices, store_run, stored_run
from inkveil.plans.scratch import Staging, ensure_checkpoint_dir
from inkveil.sources.extract import Extractor

RUNS = "run_id string, status string, created timestamp, n_files bigint, error string, at timestamp"
DOCUMENTS = (
    "run_id string, seq bigint, name string, output string, error string, accepted boolean, "
    "matches array<struct<label:string,n:int>>, n_redacted int, markdown string"
)


def submit(
    listing: DataFrame,
    rules: Sequence[Rule],
    root: str,
    run_id: str | None = None,
    style: str = "box",
    extractors: Mapping[str, Extractor] | None = None,
    slices: int = 1,
) -> str:
    """Run a listing ``(seq, name, content)`` as one job and return its id.

    Entries without a name are left out, names are made safe, and of entries
    with one name all have the last one's content.  A listing without entries,
    or without a usable name, is refused with ``ValueError`` before a run
    exists.  The run's row says ``running``, then ``done``, or ``error`` with
    the message of what broke off outside of single files.  The documents are
    stored in ``slices`` parts, in the order of ``seq``: what ``job_status``,
    ``live_progress`` and ``log_tail`` tell while it runs.
    """
    spark = listing.sparkSession
    run_id = run_id or uuid.uuid4().hex
    named = require_inputs(drop_unnamed(listing.select("seq", "name", "content")))
    safe = with_safe_names(named).select("seq", F.col("safe_name").alias("name"), "content")
    safe = require_inputs(safe, NO_VALID_FILES)
    runs = spark.createDataFrame([(run_id,)], "run_id string").withColumn("created", F.lit(_now(spark)))
    _carry_out(safe.withColumn("run_id", F.lit(run_id)), runs, rules, root, style, extractors, slices)
    return run_id


def submit_all(
    listing: DataFrame,
    jobs: DataFrame,
    root: str,
    extractors: Mapping[str, Extractor] | None = None,
    slices: int = 1,
) -> DataFrame:
    """Run the jobs of a whole table in one plan; returns those refused, ``(run_id, error)``.

    ``listing`` is ``(run_id, seq, name, content)`` and ``jobs`` has a row per
    ``run_id`` with its options (see ``rulesets.OPTIONS``) and, if wanted, the
    time it was ``created``.  Each job has what ``submit`` gives it: its own
    selection of detectors, keywords, regexes, flags and style, its own safe
    names and its row in the runs table.  Refused, and without a run, are jobs
    with an invalid regex or no rule, without entries, or without a usable
    name.  Entries of unknown jobs are left out.
    """
    spark = listing.sparkSession
    sets = RuleSets(jobs)
    created = F.col("created") if "created" in jobs.columns else F.lit(None)
    entries = drop_unnamed(listing.select("run_id", "seq", "name", "content"))
    safe = with_safe_names(entries).select("run_id", "seq", F.col("safe_name").alias("name"), "content")
    # A stored row per job: what is wrong with it, and how many entries are left to it.
    named = entries.groupBy("run_id").agg(F.lit(True).alias("named"))
    valid = safe.groupBy("run_id").agg(F.lit(True).alias("valid"))
    why = F.coalesce(
        "error",
        F.when(F.col("named").isNull(), NO_FILES),
        F.when(F.col("valid").isNull(), NO_VALID_FILES),
    )
    ensure_checkpoint_dir(spark)
    told = (
        jobs.select("run_id", F.coalesce(created.cast("timestamp"), F.lit(_now(spark))).alias("created"))
        .join(sets.jobs, "run_id")
        .join(named, "run_id", "left")
        .join(valid, "run_id", "left")
        .select("run_id", "created", why.alias("error"))
        .checkpoint()
    )
    good = told.filter("error IS NULL").select("run_id", "created")
    if not good.isEmpty():
        _carry_out(safe.join(good.select("run_id"), "run_id", "left_semi"), good, sets, root, "box", extractors, slices)
    return told.filter("error IS NOT NULL").select("run_id", "error")


def _now(spark: SparkSession):
    return spark.range(1).select(F.current_timestamp().alias("t")).first()["t"]


def _carry_out(safe: DataFrame, runs: DataFrame, rules, root: str, style: str, extractors, slices: int) -> None:
    """Redact and store the files of some runs; their notes say how that went."""
    spark = safe.sparkSession
    staging = Staging(spark)
    ensure_checkpoint_dir(spark)
    counted = safe.groupBy("run_id").agg(F.count("*").alias("n_files"))
    runs = runs.join(counted, "run_id").checkpoint()
    _note(root, runs, "running")
    try:
        keys = ["run_id", "name"]
        files = staging.store(last_write_wins(safe.select("run_id", "seq", "name", "content"), keys), "inputs")
        for number, done in enumerate(redact_in_slices(files, rules, slices, style, extractors, staging)):
            store_run(done, f"{root}/documents", mode="append" if number else "overwrite")
    except Exception as cause:
        _note(root, runs, "error", _said(cause))
    else:
        _note(root, runs, "done")
    finally:
        staging.clear()


def _said(cause: Exception) -> str:
    """What went wrong, without the trace of where."""
    return str(cause).strip().split("\n")[0]


def _note(root: str, runs: DataFrame, status: str, error: str | None = None) -> None:
    """Add a line to the notes of each run, in a folder of its own; of a run's lines the latest counts."""
    lines = runs.select(
        "run_id", F.lit(status).alias("status"), "created", "n_files", F.lit(error).cast("string").alias("error"), F.current_timestamp().alias("at")
    )
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartition(parts, "run_id").write.mode("append").partitionBy("run_id").parquet(f"{root}/runs")


def job_notes(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """The notes of all jobs, or of one: its folder alone is read."""
    notes = spark.read.schema(RUNS).parquet(f"{root}/runs")
    return notes if run_id is None else notes.filter(F.col("run_id") == run_id)


def job_runs(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """``(run_id, status, created, n_files, error)``, one row per job, or of one job alone."""
    # Of lines of one moment the finished one counts.
    latest = F.max_by(F.struct("status", "created", "n_files", "error"), F.struct("at", F.col("status") != "running"))
    return job_notes(spark, root, run_id).groupBy("run_id").agg(latest.alias("last")).select("run_id", "last.*")


def job_documents(spark: SparkSession, root: str) -> RunTables:
    """The documents of all jobs, stored by run."""
    return stored_run(spark, f"{root}/documents", DOCUMENTS)


def job_status(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """Status, error, progress and outcome of one job, or of all.

    ``(run_id, status, error, current, total, n_ok, n_failed, sentence)``.  A
    job that is unknown gives no row; see ``ledger.require_run``.
    """
    runs, results = job_runs(spark, root, run_id), job_documents(spark, root).results
    if run_id is not None:
        results = results.filter(F.col("run_id") == run_id)
    counts = run_summary(results).drop("sentence")
    told = run_outcome(runs, results).join(counts, "run_id", "left")
    n_ok, n_failed = F.coalesce("n_ok", F.lit(0)), F.coalesce("n_failed", F.lit(0))
    return told.select(
        "run_id", "status", "error", (n_ok + n_failed).cast("bigint").alias("current"),
        F.coalesce("n_files", F.lit(0)).cast("bigint").alias("total"),
        n_ok.cast("bigint").alias("n_ok"), n_failed.cast("bigint").alias("n_failed"), "sentence",
    )


PROGRESS = "run_id string, current bigint, total bigint, percent int, batch_id bigint"


def live_progress(spark: SparkSession, root: str, path: str, checkpoint: str) -> StreamingQuery:
    """Follow the documents of all jobs as they are stored, and write where each run stands to ``path``.

    A count per run is kept in the state store; a batch reads the files that
    came since the last one and writes a line for each run among them, in a
    folder of its own (overwritten if the batch is repeated).  Takes up what is
    there now and stops; called again, it goes on from there.
    """
    stored = spark.readStream.schema(DOCUMENTS).parquet(f"{root}/documents")
    counts = stored.groupBy("run_id").agg(F.count("*").alias("current"))

    def write(batch: DataFrame, batch_id: int) -> None:
        totals = job_runs(batch.sparkSession, root).select("run_id", F.col("n_files").alias("total"))
        percent = F.floor(F.col("current") / F.col("total") * 100 + 0.5).cast("int")
        lines = batch.join(totals, "run_id").select("run_id", "current", "total", percent.alias("percent"))
        lines.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def latest_progress(spark: SparkSession, path: str) -> DataFrame:
    """``(run_id, current, total, percent)``: the last line of each run that ``live_progress`` wrote."""
    lines = spark.read.schema(PROGRESS).parquet(path)
    last = lines.groupBy("run_id").agg(F.max_by(F.struct("current", "total", "percent"), "batch_id").alias("last"))
    return last.select("run_id", "last.*")


def log_tail(spark: SparkSession, root: str, run_id: str, offset: int = 0) -> DataFrame:
    """``(number, line)``: a job's log from line ``offset`` (0 is the first) on, finished or not.

    While the job runs lines are only added at the end, so whoever has read n
    lines goes on with ``offset=n``.  One run's folder is read, without texts.
    """
    total = job_runs(spark, root, run_id).select("run_id", "n_files")
    files = job_documents(spark, root).documents.filter(F.col("run_id") == run_id).join(F.broadcast(total), "run_id")
    lines = activity_log(files, "n_files").withColumn("__place", F.col("seq") * 8 + F.col("line_no"))
    placed = running_total(lines, ["run_id"], "__place", into="number")
    return placed.filter(F.col("number") > offset).select((F.col("number") - 1).alias("number"), "line")



PURGED = "run_id string, created timestamp, n_notes bigint, removed boolean"


def purge_runs(spark: SparkSession, root: str, now, ttl_seconds: int = RUN_TTL_SECONDS, exported: str | None = None) -> DataFrame:
    """Delete what expired runs have left; returns ``(run_id, created, n_notes, removed)``.

    A run is expired when it was created before ``now`` less the lifetime.  Its
    folders go from the documents and, where that is given, from ``exported``
    (files by run), and last from the notes, so a purge that breaks off is
    simply done again.  Runs that are being written stay: those whose last
    note says ``running``, and those that got another note since this purge
    read them (``removed`` is False).  The folders are deleted by tasks.
    """
    notes = job_notes(spark, root).withColumn("folder", F.regexp_extract("_metadata.file_path", "([^/]*)/[^/]*$", 1))
    seen = notes.groupBy("run_id").agg(F.count("*").alias("n_notes"), F.max("folder").alias("folder"))
    ended = job_runs(spark, root).filter("status <> 'running'")
    alive = expire_runs(ended, now, ttl_seconds).select("run_id")
    expired = ended.join(alive, "run_id", "left_anti").join(seen, "run_id").select("run_id", "created", "n_notes", "folder")

    def delete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import unquote

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        others = fs.FileSystem.from_uri(exported) if exported else None

        def drop(at: fs.FileSystem, path: str) -> None:
            if at.get_file_info(path).type == fs.FileType.Directory:
                at.delete_dir(path)

        for batch in batches:
            gone = []
            for run_id, folder, n_notes in zip(batch["run_id"], batch["folder"], batch["n_notes"], strict=True):
                own = unquote(folder)
                found = store.get_file_info(fs.FileSelector(f"{base}/runs/{own}", allow_not_found=True))
                same = sum(f.base_name.endswith(".parquet") for f in found) == n_notes
                if same:
                    drop(store, f"{base}/documents/{own}")
                    if others:
                        drop(others[0], f"{others[1]}/{run_id}")
                    drop(store, f"{base}/runs/{own}")
                gone.append(same)
            yield batch[["run_id", "created", "n_notes"]].assign(removed=gone)

    # Stored at once: looked at again, it must not be looked for again.
    ensure_checkpoint_dir(spark)
    return expired.checkpoint().mapInPandas(delete, PURGED).checkpoint()
