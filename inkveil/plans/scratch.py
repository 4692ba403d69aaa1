"""The shared folder for checkpoints and for tables written along the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors.")
        named = tempfile.mkdtemp(prefix="inkveil-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder, with its scheme.

    A folder named without one lies in the cluster's default file system, not
    on each machine's own disk.
    """
    named = ensure_checkpoint_dir(spark).rstrip("/")
    if "://" not in named and not named.startswith("file:"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        named = default.rstrip("/") + "/" + named.lstrip("/") if "://" in default.rstrip("/") else f"file://{named}"
    return f"{named}/{purpose}-{uuid.uuid4().hex}"


class Staging:
    """Tables written along the way, and their removal once the result is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame, purpose: str) -> DataFrame:
        """``df`` as a compressed table: read again, not worked out again, if an executor is lost."""
        path = scratch_path(self.spark, purpose)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            remove(self.spark, self.paths.pop())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table written along the way."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
