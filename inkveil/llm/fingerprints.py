"""Document fingerprints: a quartile bucket digest with a bounded difference score.

Every byte triplet of a text is hashed into one of 128 buckets.  A bucket's
code says in which quarter of all bucket counts its own count lies; the digest
is the length on a logarithmic scale, the ratios of the quartiles, and the
codes.  A change to a part of a text moves few counts across a quartile, so
alike texts have alike codes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import batches, ranged

BUCKETS = 128
OFFSETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))  # triplets in a window of five bytes
LENGTH_STEP = 1.1  # a length code is a power of this
CODE_COST = np.array([0, 1, 2, 6])  # by distance of two bucket codes
MOST = 1.625 * BUCKETS  # of unrelated texts, whose codes are equally likely
_MULTIPLIER = np.uint32(0x9E3779B1)


def digest(text: str | None) -> str:
    """72 hexadecimal digits: length, quartile ratios (two), checksum, 128 codes of two bits.

    NULL and empty texts have the same digest; equal texts have equal ones.
    """
    data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for salt, (a, b, c) in enumerate(OFFSETS):
        n = len(data) - c
        if n > 0:
            mixed = data[a : a + n] | (data[b : b + n] << 8) | (data[c : c + n] << 16)
            mixed = (mixed + np.uint32(salt << 24)) * _MULTIPLIER
            mixed ^= mixed >> np.uint32(15)
            mixed *= _MULTIPLIER
            counts += np.bincount(mixed >> np.uint32(25), minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    body = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    length = min(255, round(math.log(1 + len(data), LENGTH_STEP)))
    ratios = [int(15 * q // q3) if q3 else 0 for q in (q1, q2)]
    check = int(data.sum()) & 0xFF
    return bytes([length, ratios[0], ratios[1], check]).hex() + body.astype(np.uint8).tobytes().hex()


def _parts(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8)
    body = raw[4:]
    codes = np.stack([body >> s & 3 for s in (0, 2, 4, 6)], axis=1).ravel()
    return raw[:4].astype(np.int64), codes.astype(np.int64)


def likeness(one: str, other: str) -> float:
    """1 for equal digests, 0 from the difference of unrelated texts on."""
    if one == other:
        return 1.0
    (head, codes), (head2, codes2) = _parts(one), _parts(other)
    apart = CODE_COST[np.abs(codes - codes2)].sum()
    apart += 2 * abs(int(head[0] - head2[0])) + int(np.abs(head[1:3] - head2[1:3]).sum())
    apart += int(head[3] != head2[3])
    return max(0.0, 1.0 - float(apart) / MOST)


def with_fingerprint(df: DataFrame, text_col: str = "text", into: str = "fingerprint") -> DataFrame:
    """Add the digest of a text column; a column named ``into`` is replaced."""
    of = F.pandas_udf(lambda texts: pd.Series([digest(t) for t in texts], dtype=str), "string")
    return df.withColumn(into, of(F.col(text_col)))


def with_likeness(df: DataFrame, one: str, other: str, into: str = "likeness") -> DataFrame:
    """Add the likeness (0 to 1) of two digest columns; NULL where either is NULL."""

    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = zip(a, b, strict=True)
        return pd.Series([None if x is None or y is None else likeness(x, y) for x, y in pairs], dtype=float)

    return df.withColumn(into, F.pandas_udf(of, "double")(F.col(one), F.col(other)))


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint against that of its edited form and of the next text.

    The edited form ends with the head of the next document in the order of
    (doc_id, text): its last quarter is replaced.  The next of the last is the
    first.  NULL texts are empty, NULL ids come first, repeated rows are
    documents of their own, an empty table gives no rows, and other columns
    are not read.  Texts are shuffled once, by ranges of ids; a task reads its
    ranges in order and holds two texts.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            waiting = None  # (part, doc_id, text, fingerprint)
            for batch in parts:
                for part, head, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if head and (waiting is None or waiting[0] != part):
                        continue
                    mark = digest(text)
                    if waiting is not None:
                        yield _compared(waiting[1:], text, mark)
                    waiting = None if head else (part, doc, text, mark)

        yield from batches(rows(), _OUT)

    return ranged(docs, id_col, text_col, with_next=True).mapInArrow(
        run,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )


def _compared(own: tuple, following: str, following_mark: str) -> tuple:
    doc, text, mark = own
    quarter = len(text) // 4
    edited = text[: len(text) - quarter] + following[:quarter]
    edited_mark = digest(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
    near = likeness(mark, edited_mark), likeness(mark, following_mark)
    return doc, len(text), sha, mark, edited_mark, *near


def op4_fingerprint(docs: DataFrame) -> DataFrame:
    """The contract's columns are those of ``compare_edited``."""
    return compare_edited(docs)
