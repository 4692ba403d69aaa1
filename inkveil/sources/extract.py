"""Any source to Markdown text, with failures as data."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from html.entities import html5, name2codepoint

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.names import suffix
from inkveil.plans.layout import with_small_batches
from inkveil.sources.files import TEXT_SUFFIXES, decode_text
from inkveil.sources.html import KEPT, page_markdown

HTML_SUFFIXES = (".html", ".htm")
Extractor = Callable[[bytes], str]

_BLANK_STEPS = ((r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"))
# The named references of HTML that end in a semicolon; a hard space is a space here.
_NAMED = {name[:-1]: char.replace("\xa0", " ") for name, char in html5.items() if name.endswith(";")}
_COMMON = {name: _NAMED[name] for name in (*name2codepoint, "apos")}  # tried first: maps are searched in order
_REFERENCE = (
    r"^(?:#0*([0-9]{1,7})(?![0-9]);?|#[xX]0*([0-9a-fA-F]{1,6})(?![0-9a-fA-F]);?|([A-Za-z][A-Za-z0-9]{1,30});)"
)


def _map(pairs: Mapping[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _character(code: Column) -> Column:
    """The character of a code point; U+FFFD for what is none."""
    known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    safe = F.when(known, code).otherwise(0xFFFD)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def decode_references(text: Column) -> Column:
    """Character references as characters: named ones, decimal and hexadecimal ones.

    One pass over the pieces between ampersands, so that what a reference
    yields is never read as part of another one.  Texts without an ampersand
    are passed on.
    """
    common, names = _map(_COMMON), _map(_NAMED)

    def piece(part: Column, at: Column) -> Column:
        decimal, hexadecimal = F.regexp_extract(part, _REFERENCE, 1), F.regexp_extract(part, _REFERENCE, 2)
        name = F.regexp_extract(part, _REFERENCE, 3)
        char = (
            F.when(decimal != "", _character(decimal.cast("bigint")))
            .when(hexadecimal != "", _character(F.conv(hexadecimal, 16, 10).cast("bigint")))
            .when(name != "", F.coalesce(F.try_element_at(common, name), F.try_element_at(names, name)))
        )
        rest = F.regexp_replace(part, _REFERENCE, "")
        found = F.when(char.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), part))
        return F.when(at == 0, part).otherwise(found)

    decoded = F.array_join(F.transform(F.split(text, "&", -1), piece), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def _pages_udf():
    def run(pages: pa.Array) -> pa.Array:
        return pa.array((page_markdown(p.as_py()) if p.is_valid else None for p in pages), type=pa.string())

    return F.arrow_udf(run, "string").asNondeterministic()


def html_to_markdown(html: Column) -> Column:
    """Headings, lists, tables, paragraphs and preformatted lines of an HTML page as Markdown text.

    Tags are read by one pass in Arrow batches; references are decoded and
    blanks squeezed by SQL expressions.  What stands only in attributes, such
    as the target of a link, is no text of the page and is dropped with its tag.
    """
    text = decode_references(_pages_udf()(html))
    for pattern, mark in _BLANK_STEPS:
        text = F.regexp_replace(text, pattern, mark)
    return F.translate(F.btrim(text, F.lit(" \n")), "".join(KEPT.values()), "".join(KEPT))


def _extractor_udf(extractors: Mapping[str, Extractor]):
    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for suffixes, contents in batches:
            rows = []
            for kind, content in zip(suffixes, contents):
                try:
                    rows.append((extractors[kind](bytes(content)), None) if kind else (None, None))
                except Exception as cause:  # a bad file is a row, not a failed job
                    rows.append((None, str(cause) or type(cause).__name__))
            yield pd.DataFrame(rows, columns=["text", "error"], dtype=object)

    return run


def extract(
    df: DataFrame,
    extractors: Mapping[str, Extractor] | None = None,
    name: str = "name",
    content: str = "content",
) -> DataFrame:
    """Add ``text`` and ``error``; exactly one of the two is NULL.

    Text and Markdown are converted by SQL expressions, HTML by one pass over its tags.  ``extractors``
    maps further suffixes (".pdf") to functions from bytes to text, run in
    Arrow batches; the bytes of other rows are not sent to Python.  Missing
    content counts as an empty file.  Without ``extractors`` whether a file
    fails is known from its name alone, so that listings need not read content.
    """
    kind = suffix(F.col(name))
    plain, html = kind.isin(*TEXT_SUFFIXES), kind.isin(*HTML_SUFFIXES)
    source = F.coalesce(F.col(content), F.expr("X''"))
    decoded = decode_text(source)
    work = df = with_small_batches(df)
    # The bytes of other files are not sent to Python.
    text = F.when(plain, decoded).when(html, html_to_markdown(F.when(html, decoded)))
    missing = F.concat(F.lit("No extractor for '"), kind, F.lit("'"))
    error = F.when(~(plain | html), missing)
    if extractors:
        known = {k.lower(): f for k, f in extractors.items()}
        own = kind.isin(*known)
        done = _extractor_udf(known)(F.when(own, kind), F.when(own, source))
        work = df.withColumn("__done", done)
        text = F.when(own, F.col("__done.text")).otherwise(text)
        error = F.when(own, F.col("__done.error")).otherwise(error)
    return work.withColumns({"text": text, "error": error}).drop("__done")
