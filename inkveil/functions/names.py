"""File names: suffix, stem, safe form, output form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes accepted for a preview, and the output name.
ACCEPTED_SUFFIXES = (
    ".pdf", ".docx", ".pptx", ".xlsx", ".html", ".htm", ".md", ".txt",
    ".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".asciidoc",
)
OUTPUT_ENDING = "_redacted"
OUTPUT_SUFFIX = ".md"

# A last suffix: something, a dot, something without dots.
_LAST_SUFFIX = r"(?s)^(.+)(\.[^.]+)\z"
_BLANKS = r"[\s\x1c-\x1f/]+"


def stem(name: Column) -> Column:
    """The name without its last suffix."""
    return F.regexp_replace(name, _LAST_SUFFIX, "$1")


def suffix(name: Column) -> Column:
    """The last suffix in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, _LAST_SUFFIX, 2))


def accepted(name: Column) -> Column:
    """Whether a source of this name gets a preview."""
    return suffix(name).isin(*ACCEPTED_SUFFIXES)


def _fold_udf():
    """Accented letters to their ASCII base; what has none is dropped."""

    @F.pandas_udf("string")
    def fold(names: pd.Series) -> pd.Series:
        return names.map(
            lambda n: unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode("ascii"),
            na_action="ignore",
        )

    return fold


def safe_name(name: Column) -> Column:
    """The name as it may be used in a folder: ASCII, no path, no blanks.

    Names that are ASCII already never reach Python.
    """
    is_ascii = F.octet_length(name) == F.length(name)
    ascii_name = F.when(is_ascii, name).otherwise(_fold_udf()(F.when(~is_ascii, name)))
    joined = F.regexp_replace(ascii_name, _BLANKS, "_")
    return F.btrim(F.regexp_replace(joined, r"[^A-Za-z0-9_.-]", ""), F.lit("._"))


def output_name(base: Column, number: Column) -> Column:
    """``<stem>_redacted.md`` for number 1, ``<stem>_redacted_<n>.md`` beyond."""
    tail = F.when(number == 1, F.lit("")).otherwise(F.concat(F.lit("_"), number.cast("string")))
    return F.concat(base, F.lit(OUTPUT_ENDING), tail, F.lit(OUTPUT_SUFFIX))
