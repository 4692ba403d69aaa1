"""Totals over all jobs that follow their runs: added, replaced and purged.

A log holds signed counts per run and label.  An update looks at the notes of
the runs, counts the documents of those that are new or were written again,
and takes back what replaced and purged runs had added.  The totals are the
sum of the log, which has a few rows per run, however many documents there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators.skew import checked_broadcast
from inkveil.plans.jobs import job_documents, job_notes, job_runs
from inkveil.plans.scratch import ensure_checkpoint_dir

# Rows without a label mark that a run is counted (sign 1) or no longer (-1), as of ``version``.
LOG = "run_id string, version timestamp, label string, sign int, n_docs bigint, n_matches bigint, batch int"


def totals_log(spark: SparkSession, path: str) -> DataFrame:
    """The log below ``path``; empty before the first update."""
    spark.createDataFrame([], LOG).write.mode("append").partitionBy("batch").parquet(path)
    return spark.read.schema(LOG).parquet(path)


def update_totals(spark: SparkSession, root: str, path: str) -> DataFrame:
    """Bring the log up to the jobs below ``root``; returns the runs that were read, ``(run_id, version)``.

    Runs that are being written keep their old counts until they are done;
    runs that broke off have none.  An update that fails half way leaves no
    batch and is done again by the next one.
    """
    ensure_checkpoint_dir(spark)
    log = totals_log(spark, path)
    batch = (log.agg(F.max("batch")).first()[0] or 0) + 1
    marks = log.filter("label IS NULL").groupBy("run_id")
    known = marks.agg(F.sum("sign").alias("counted"), F.max_by("version", F.struct("batch", "sign")).alias("had"))
    known = known.filter("counted = 1").select("run_id", "had")
    versions = job_notes(spark, root).groupBy("run_id").agg(F.max("at").alias("version"))
    now = job_runs(spark, root).join(versions, "run_id").select("run_id", "status", "version")
    # A row per run, however it changed; stored, so that all of this update sees the same.
    state = now.join(known, "run_id", "full").checkpoint()
    fresh = state.filter("status = 'done' AND NOT version <=> had").select("run_id", "version")
    lost = state.filter("had IS NOT NULL AND (status IS NULL OR status = 'error' OR (status = 'done' AND version <> had))")

    back = log.join(lost.select("run_id"), "run_id", "left_semi").groupBy("run_id", "label").agg(
        F.max("version").alias("version"), *[(-F.sum(c)).alias(c) for c in ("sign", "n_docs", "n_matches")]
    )
    # Folders of other runs are not opened.
    documents = job_documents(spark, root).documents.join(checked_broadcast(fresh), "run_id")
    counts = documents.select("run_id", "version", F.inline("matches")).groupBy("run_id", "version", "label")
    counts = counts.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_matches")).withColumn("sign", F.lit(0))
    marked = fresh.select(
        "run_id", "version", F.lit(None).cast("string").alias("label"), F.lit(1).alias("sign"),
        F.lit(0).cast("bigint").alias("n_docs"), F.lit(0).cast("bigint").alias("n_matches"),
    )
    columns = ["run_id", "version", "label", F.col("sign").cast("int"), "n_docs", "n_matches"]
    rows = back.select(columns).unionByName(counts.select(columns)).unionByName(marked.select(columns))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return fresh


def incremental_totals(spark: SparkSession, path: str) -> DataFrame:
    """``(label, n_docs, n_matches)`` over all runs there are, labels with hits only."""
    sums = totals_log(spark, path).filter("label IS NOT NULL").groupBy("label")
    return sums.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_matches").alias("n_matches")).filter("n_matches > 0")
