"""What several of the operators share: words, tables stored on the way, ordered ranges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.plans.scratch import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
LEAST = -(2**63)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case: ``bytes`` splits at exactly the six ASCII spaces."""
    return (text or "").encode("utf-8", "replace").lower().split()


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    Used where a result is read more than once: a lost executor then costs a
    re-read, not the work that led there.
    """
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, ranges: int) -> list[int]:
    """At most ``ranges - 1`` values that cut a BIGINT column into ranges of like counts."""
    if ranges < 2:
        return []
    at = [i / ranges for i in range(1, ranges)]
    found = df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", at, 0.25 / ranges)
    return sorted({int(x) for x in found})


def range_of(key: Column, bounds: Sequence[int]) -> Column:
    """The number of bounds at or below ``key``, by a search tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < F.lit(bounds[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(bounds))


def ranged(docs: DataFrame, id_col: str, text_col: str, with_next: bool) -> DataFrame:
    """Rows ``(part, head, doc_id, text)``, part by part in the order of (doc_id, text).

    NULL ids come first and NULL texts count as empty.  A part is a range of
    ids and lies in one partition as a whole; parts follow one another in the
    order of their numbers.  With ``with_next`` each part ends with a copy of
    the first row of the part after it (the last: of the first one), marked
    ``head``, so that a task sees the row that follows each of its own.
    What the driver holds are the bounds and the first id of each part.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LEAST)).alias("__id"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    bounds = range_bounds(docs.select(F.col(id_col).cast("bigint").alias(id_col)), id_col, 2 * n)
    rows = rows.withColumn("part", range_of(F.col("__id"), bounds)).withColumn("head", F.lit(False))
    if with_next:
        first = sorted(
            (r["part"], r["id"]) for r in rows.groupBy("part").agg(F.min("__id").alias("id")).collect()
        )
        follow = [(first[i - 1][0], first[i][1]) for i in range(len(first))]
        if follow:
            heads = spark.createDataFrame(follow, "to_part int, __id bigint")
            copies = rows.join(F.broadcast(heads), "__id").select(
                "__id", "doc_id", "text", F.col("to_part").alias("part"), F.lit(True).alias("head")
            )
            rows = rows.unionByName(copies)
    small_batches(spark)
    placed = rows.repartition(n, "part").sortWithinPartitions("part", "head", "__id", "text")
    return placed.select("part", "head", "doc_id", "text")


MOST_IN_BATCH = 2000


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand texts to Python in batches of at most ``MOST_IN_BATCH`` rows.

    A batch is held several times over while it is handed on; the session's
    own limit is kept where it is lower.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= MOST_IN_BATCH:
        spark.conf.set(name, str(MOST_IN_BATCH))


def batches(
    rows: Iterator[tuple], schema: pa.Schema, size: int = 5000
) -> Iterator[pa.RecordBatch]:
    """Row tuples to record batches of at most ``size`` rows; then Arrow's free memory is given back."""
    kept: list = []
    for row in rows:
        kept.append(row)
        if len(kept) >= size:
            yield _batch(kept, schema)
            kept = []
    if kept:
        yield _batch(kept, schema)
    pa.default_memory_pool().release_unused()


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def ordered_sha256(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, separator: str
) -> DataFrame:
    """BIGINT ``keys`` and ``sha256``: the hash of each group's values in order, with ``separator`` between them.

    Values go through the hash one by one, so a task holds a batch of them
    however large a group is.  NULL keys form groups, too.
    """
    out = pa.schema([(k, pa.int64()) for k in keys] + [("sha256", pa.string())])
    between = separator.encode()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            at, digest = None, None
            for part in parts:
                *own, values = (c.to_pylist() for c in part.columns)
                for key, text in zip(zip(*own, strict=True), values, strict=True):
                    if digest is not None and key == at:
                        digest.update(between + text.encode())
                        continue
                    if digest is not None:
                        yield *at, digest.hexdigest()
                    at, digest = key, hashlib.sha256(text.encode())
            if digest is not None:
                yield *at, digest.hexdigest()

        yield from batches(groups(), out)

    dealt = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, *order)
    ddl = ", ".join(f"`{k}` bigint" for k in keys) + ", sha256 string"
    return dealt.select(*[F.col(k).cast("bigint").alias(k) for k in keys], value).mapInArrow(run, ddl)
