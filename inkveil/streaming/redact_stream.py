"""The same redaction over streams.

Redaction looks at one document at a time, so it needs no state and no
watermark.  Only collision-free names depend on what came before: a second
query over the names alone keeps one number per stem in the state store, the
last one given, and reads nothing of what was written earlier.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkveil.functions.names import output_name, stem
from inkveil.functions.rules import Rule
from inkveil.operators.redact import redact
from inkveil.operators.skew import checked_broadcast
from inkveil.sources.extract import extract
from inkveil.sources.files import FILE_SCHEMA, as_files

NUMBERS = "seq bigint, name string, number bigint"
STORED = "seq bigint, name string, error string, n_redacted int, markdown string, batch_id bigint"


def stream_files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """New files below a folder as they arrive: (path, name, size, content)."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return as_files(reader.load(folder))


def redact_stream(
    stream: DataFrame, rules: Sequence[Rule], style: str = "box", **options
) -> DataFrame:
    """Redact the text column of a stream; the result is a stream, too."""
    if not stream.isStreaming:
        raise ValueError("Expected a streaming DataFrame.")
    return redact(stream, rules, style, **options)


def start_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now to a parquet table, exactly once, then stop."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


@dataclass(frozen=True)
class NamedStream:
    """The two queries of a stream with names: the redacted texts, and the numbers of the names."""

    texts: StreamingQuery
    names: StreamingQuery

    def awaitTermination(self) -> None:  # noqa: N802, as on a StreamingQuery
        self.texts.awaitTermination()
        self.names.awaitTermination()


def numbered(names: DataFrame) -> DataFrame:
    """Number a stream ``(seq, name)`` by stem: ``(seq, name, number)``, in the order of (seq, name) in a batch.

    The state is one number per stem, whatever was given before.  A task holds
    the numbers and names that one batch has of a stem, never a text.
    """

    def number(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts).sort_values(["seq", "name"], kind="stable")
        taken = state.get[0] if state.exists else 0
        state.update((taken + len(rows),))
        yield pd.DataFrame({"seq": rows["seq"], "name": rows["name"], "number": range(taken + 1, taken + len(rows) + 1)})

    stems = names.select(stem(F.col("name")).alias("stem"), F.col("seq").cast("bigint").alias("seq"), "name")
    return stems.groupBy("stem").applyInPandasWithState(
        number, NUMBERS, "taken bigint", "append", GroupStateTimeout.NoTimeout
    )


def start_named(
    stream: DataFrame,
    rules: Sequence[Rule],
    path: str,
    checkpoint: str,
    style: str = "box",
) -> NamedStream:
    """Redact files ``(seq, name, content)`` of a stream and give them unused names.

    Texts go to ``path`` and numbers to ``<path>_names``, each batch to its own
    folder, which a batch that is repeated after a failure overwrites; the
    state store then is what it was before the batch.  Texts are not shuffled,
    and a batch costs the same however many came before.  (seq, name) tells
    files apart.
    """
    texts = extract(stream)
    done = redact(texts, rules, style, into="markdown").select(
        F.col("seq").cast("bigint").alias("seq"), "name", "error", "n_redacted", "markdown"
    )
    # Without extractors an error is known from the name, so contents are not read here.
    given = numbered(texts.filter("error IS NULL").select("seq", "name"))
    return NamedStream(_batches(done, path, f"{checkpoint}/texts"), _batches(given, f"{path}_names", f"{checkpoint}/names"))


def _batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now, each batch to a folder of its own, then stop."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def named_outputs(spark: SparkSession, path: str) -> DataFrame:
    """``(seq, name, output, n_redacted, markdown, batch_id)`` as written by ``start_named``.

    A file is listed once its name is known; one that cannot be read has none
    and an empty output.
    """
    texts = spark.read.schema(STORED).parquet(path)
    numbers = spark.read.schema(NUMBERS).parquet(f"{path}_names").drop("batch_id")
    good = texts.filter("error IS NULL").join(checked_broadcast(numbers), ["seq", "name"])
    named = good.withColumn("output", output_name(stem(F.col("name")), F.col("number")))
    failed = texts.filter("error IS NOT NULL").withColumn("output", F.lit(""))
    columns = ["seq", "name", "output", "n_redacted", "markdown", "batch_id"]
    return named.select(columns).unionAll(failed.select(columns))
