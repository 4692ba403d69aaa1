"""Files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_SUFFIXES = (".txt", ".md")
TEXT_GLOB = "*.{[tT][xX][tT],[mM][dD]}"
FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 text: bad sequences become U+FFFD, line ends become ``\\n``."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(text, r"\r\n?", "\n")


def as_files(raw: DataFrame) -> DataFrame:
    """(path, name, size, content) from Spark's binary file columns."""
    return raw.select(
        "path",
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
        F.col("length").alias("size"),
        "content",
    )


def read_files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """All files below a folder; content is read only where it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return as_files(reader.load(folder))


def scan_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Text and Markdown files as (path, name, text); other files are not opened."""
    files = read_files(spark, folder, TEXT_GLOB)
    return files.select("path", "name", decode_text(F.col("content")).alias("text"))
