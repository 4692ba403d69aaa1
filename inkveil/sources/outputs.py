"""Where redacted documents go.  Sources are never changed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators.skew import GROUP, checked_broadcast, grouped


ROWS_PER_FILE = 100_000


def by_run(documents: DataFrame, rows_per_file: int = ROWS_PER_FILE, max_runs: int = 100_000) -> DataFrame:
    """Rows dealt by run: a small run to one task, a large one to several.

    How many is known from one count per run, so that tasks times runs files
    are not written, nor a run with a third of all rows by one task.  Rows are
    shuffled once: runs that need several tasks have over ``rows_per_file``
    rows, so they are few, and their numbers are broadcast; beyond ``max_runs``
    such runs they are joined.
    """
    counts = documents.groupBy("run_id").agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("__shares"))
    large = checked_broadcast(grouped(counts.filter("__shares > 1"), ["run_id"]).drop("run_id"), max_runs)
    placed = grouped(documents, ["run_id"]).join(large, GROUP, "left").withColumn(
        "__share", F.pmod(F.xxhash64("output"), F.coalesce("__shares", F.lit(1)))
    )
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "run_id", "__share").select(*documents.columns)


def write_outputs(documents: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Store ``(run_id, output, markdown)`` as a table with a folder per run.

    Writing a run again replaces that run and leaves the others alone.  A run
    of up to ``rows_per_file`` documents is one file.  ``documents`` is read
    twice, the first time for the run ids alone.
    """
    columns = by_run(documents.select("run_id", "output", "markdown"), rows_per_file)
    writer = columns.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").parquet(path)


def read_outputs(spark: SparkSession, path: str, run_id_type: str = "string") -> DataFrame:
    """The stored table."""
    schema = f"output string, markdown string, run_id {run_id_type}"
    return spark.read.schema(schema).parquet(path)


def bundle_manifest(outputs: DataFrame, run_id) -> DataFrame:
    """Names and sizes of one run's outputs, sorted by name."""
    chosen = outputs.filter((F.col("run_id") == F.lit(run_id)) & (F.col("output") != ""))
    return chosen.select("output", F.octet_length("markdown").alias("size")).orderBy("output")


def export_files(outputs: DataFrame, folder: str, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Write one UTF-8 file per output; returns the keys and names written (run it by an action).

    ``folder`` is a URI every executor can reach.  A file goes to
    ``<folder>/<key>/.../<output>``, so equal names of different runs do not
    meet.  Keys and names that are no plain file names (empty, ``.``, ``..``,
    or with a slash) are refused.  A file is written under a temporary name
    and moved, so a repeated task leaves the same files behind.
    """
    names = [*keys, "output"]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from uuid import uuid4

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for *path, markdown in batch[[*names, "markdown"]].itertuples(index=False):
                parts = [str(p) for p in path]
                if any(p in ("", ".", "..") or "/" in p for p in parts):
                    raise ValueError(f"Unsafe output path {parts}")
                below = "/".join([base, *parts[:-1]])
                if below not in made:
                    store.create_dir(below, recursive=True)
                    made.add(below)
                draft = f"{below}/.{uuid4().hex}"
                with store.open_output_stream(draft) as stream:
                    stream.write(markdown.encode("utf-8"))
                store.move(draft, f"{below}/{parts[-1]}")
            yield batch[names]

    named = outputs.filter(F.col("output") != "").select(*names, F.coalesce("markdown", F.lit("")).alias("markdown"))
    return named.mapInPandas(write, named.select(*names).schema)
