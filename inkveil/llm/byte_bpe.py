"""Byte-level BPE: texts to ids by a table of ranks, and ids back to raw bytes.

The library ``tiktoken`` merges bytes by rank inside each match of a pattern.
A long text is handed to it in pieces that end where every reading of the
pattern ends a match, so that the ids are those of the whole text while the
library sees a bounded piece at a time: behind an ASCII letter, digit or mark
that is followed by an ASCII character which cannot belong to the same match.
The one thing it cannot read at any length, a very long run of blanks, is a
match of its own and is merged without the pattern.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import small_batches


@dataclass(frozen=True)
class BpeRules:
    """``ranks`` is a rank file: a name among the public tokenizers, or a path that executors can open.

    Texts of more than ``piece`` code points are cut; runs of at least
    ``blanks`` of them are merged on their own.
    """

    ranks: str = "byte_bpe_50k.tiktoken"
    piece: int = 1 << 18
    blanks: int = 1 << 15


# What the pattern's \s holds (Unicode's White_Space).
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_BLANK}]{{2,}}")
# An apostrophe may begin a match with the letters behind it, so it is not among the marks.
_SAFE = re.compile(
    r"(?<=[A-Za-z])(?=[\x00-@\[-`{-\x7f])|(?<=[0-9])(?=[\x00-/:-\x7f])"
    r"|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z0-9\t-\r ])"
)


@lru_cache(maxsize=4)
def encoding_of(ranks: str) -> tiktoken.Encoding:
    """The vocabulary of a rank file, without special tokens; built once per worker."""
    path = ranks if "/" in ranks else public_tokenizers.path(ranks)
    with open(path, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
    )


def pieces(text: str, rules: BpeRules = BpeRules()) -> Iterator[tuple[str, bool]]:
    """A text as ``(piece, whole)``: ``whole`` pieces are one match, the others any number of them."""
    if len(text) <= min(rules.piece, rules.blanks):
        yield text, False
        return
    at = 0
    for run in _RUN.finditer(text):
        if run.end() - run.start() < rules.blanks:
            continue
        yield from _cut(text, at, run.start(), rules)
        # The last blank before a word belongs to what follows it.
        at = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start() : at], True
    yield from _cut(text, at, len(text), rules)


def _cut(text: str, start: int, end: int, rules: BpeRules) -> Iterator[tuple[str, bool]]:
    while end - start > rules.piece:
        found = _SAFE.search(text, start + rules.piece, end)
        if found is None:
            break
        yield text[start : found.start()], False
        start = found.start()
    if start < end:
        yield text[start:end], False


def encode_text(encoding: tiktoken.Encoding, text: str, rules: BpeRules = BpeRules()) -> np.ndarray:
    """The ids of a whole text as little-endian unsigned 32-bit integers."""
    found = []
    for piece, whole in pieces(text, rules):
        if whole:
            ids = encoding._core_bpe.encode_single_piece(piece.encode())
            found.append(np.array(ids, dtype="<u4"))
        else:
            found.append(encoding.encode_to_numpy(piece, disallowed_special=()).astype("<u4", copy=False))
    return found[0] if len(found) == 1 else np.concatenate(found or [np.zeros(0, dtype="<u4")])


def encoded(text: Column, rules: BpeRules = BpeRules()) -> Column:
    """A text's ids as BINARY, four bytes each, least byte first; a NULL stays NULL."""

    def run(texts: pa.Array) -> pa.Array:
        encoding = encoding_of(rules.ranks)
        ids = (None if t is None else encode_text(encoding, t, rules).tobytes() for t in texts.to_pylist())
        return pa.array(ids, type=pa.binary())

    # Not copied into each place that uses the result.
    return F.arrow_udf(run, "binary").asNondeterministic()(text)


def decoded(ids: Column, rules: BpeRules = BpeRules()) -> Column:
    """The raw bytes that such ids stand for, valid UTF-8 or not; a NULL stays NULL.

    An id outside the vocabulary is an error.
    """

    def run(packed: pa.Array) -> pa.Array:
        encoding = encoding_of(rules.ranks)
        raw = (
            None if b is None else encoding.decode_bytes(np.frombuffer(b, dtype="<u4").tolist())
            for b in packed.to_pylist()
        )
        return pa.array(raw, type=pa.binary())

    return F.arrow_udf(run, "binary").asNondeterministic()(ids)


def encode_documents(
    docs: DataFrame, text_col: str = "text", into: str = "ids", rules: BpeRules = BpeRules()
) -> DataFrame:
    """``docs`` with the BINARY column ``into`` (replaced where there is one) of every text's ids.

    NULL and empty texts have no ids (an empty value).  A very long text is one
    row like any other: its pieces are encoded one by one, so a task holds the
    text and its ids.  Texts in which the pattern finds no end (one word of
    many megabytes) go whole.  Rows do not meet: repeated rows, ties and NULLs
    in other columns change nothing, an empty table stays empty, other columns
    are kept whatever their names.  Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(into, encoded(F.coalesce(F.col(text_col), F.lit("")), rules))


def decode_documents(
    docs: DataFrame, ids_col: str = "ids", into: str = "decoded", rules: BpeRules = BpeRules()
) -> DataFrame:
    """``docs`` with the BINARY column ``into`` of the bytes that the ids of each row stand for."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, decoded(F.col(ids_col), rules))


def op12_byte_bpe(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every document."""
    done = decode_documents(encode_documents(docs.select("doc_id", "text")))
    return done.select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
