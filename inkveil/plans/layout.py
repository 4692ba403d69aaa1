"""Session settings and input layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Regex work is bound by CPU: smaller input splits keep tasks short, so that a
# lost executor costs little and stragglers even out.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
# A batch is held several times over while Python works on it, by as many
# workers as an executor has cores.
SMALL_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
INPUT_PARTITIONS = "spark.inkveil.inputPartitions"


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """A session builder with the settings this package is laid out for."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def with_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session has been told to hand rows to Python in small batches.

    Lower limits of the session are kept.
    """
    conf = df.sparkSession.conf
    for name, most in SMALL_BATCH.items():
        if not 0 < int(conf.get(name).removesuffix("b")) <= most:
            conf.set(name, str(most))
    return df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many partitions as the caller asked for in ``INPUT_PARTITIONS``.

    Unset, a table that is read by fewer tasks than there are cores is dealt by
    ``keys``: a file of one row group is read by one task, and regex work is
    bound by CPU.  Others are not moved at any size.
    """
    asked = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    if asked:
        return df.repartition(int(asked), *keys)
    return df if df.rdd.getNumPartitions() >= cores(df.sparkSession) else dealt(df, *keys)


def cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to as many tasks as a shuffle has, or two for each core.

    For narrow rows from which much is made: how many bytes of a file a task
    reads says little about its work.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * cores(spark)), *keys)
