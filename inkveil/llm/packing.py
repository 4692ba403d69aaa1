"""Packing: cuts of the token stream by order-preserving dynamic programming.

Documents follow one another by id as one stream of tokens.  A sequence is a
stretch of at most L tokens between two cut places: document ends cost nothing,
sentence ends a little, and places inside a sentence more.  With f(j) the least
cost of a stream that ends at place j,

    f(j) = penalty(j) + min over i within L tokens of f(i) + L - (pos j - pos i)

and the minimum of f(i) + pos i over the moving stretch is the head of a
monotone queue, so every place is entered and left once.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from inkveil.llm.byte_bpe import BpeRules, encode_text
from inkveil.llm.common import batches, ranged


@dataclass(frozen=True)
class PackingRules:
    """Lengths in tokens; penalties in tokens of padding that a cut may save.

    ``ranks`` is the byte-BPE vocabulary as a table of ranks: the same
    vocabulary, and so the same ids, as the library ``tokenizers`` gives with
    the JSON form of it, at several times the speed (a test compares them).
    The added tokens of that form, in a file of the same name beside it, are
    found in texts, too.
    ``stretch`` is the number of tokens after which a stretch is closed at the
    next document end, so that a task holds a bounded part of the stream.
    """

    length: int = 1024
    end_id: int = 0
    sentence_penalty: int = 12
    inside_penalty: int = 96
    grid: int = 128
    stretch: int = 1 << 20
    ranks: str = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=1)
def tokenizer(ranks: str) -> tiktoken.Encoding:
    """The vocabulary ``ranks`` of the public tokenizers, or of a file by that path; built once per worker."""
    path = ranks if "/" in ranks else public_tokenizers.path(ranks)
    with open(path, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    form = Path(path).with_suffix(".json")
    added = json.loads(form.read_text("utf-8"))["added_tokens"] if form.exists() else []
    return tiktoken.Encoding(
        "packing",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=table,
        special_tokens={token["content"]: token["id"] for token in added},
    )


def token_ids(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a text of any length, in which added tokens are one id each."""
    if len(text) <= BpeRules().blanks:
        return encoding.encode(text, allowed_special="all", disallowed_special=())
    added = encoding.special_tokens_set
    parts = re.split("(" + "|".join(map(re.escape, sorted(added))) + ")", text) if added else [text]
    ids: list[int] = []
    for part in parts:
        if part in added:
            ids.append(encoding.encode_single_token(part))
        else:
            ids += encode_text(encoding, part).tolist()
    return ids


@lru_cache(maxsize=1)
def sentence_ends(ranks: str, end_id: int) -> np.ndarray:
    """By token id: whether a sentence can end with it."""
    encoding = tokenizer(ranks)
    found = np.zeros(encoding.max_token_value + 2, dtype=bool)
    for i in range(encoding.max_token_value + 1):
        try:
            found[i] = encoding.decode_single_token_bytes(i).endswith((b".", b"!", b"?", b"\n"))
        except KeyError:
            continue
    found[end_id] = True
    return found


def cut_places(
    ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, rules: PackingRules
) -> tuple[np.ndarray, np.ndarray]:
    """Places (tokens before a cut) in ascending order, and the penalty of each."""
    grid = np.arange(rules.grid, len(ids), rules.grid)
    stops = np.flatnonzero(sentence[ids]) + 1
    penalty = np.full(len(ids) + 1, -1, dtype=np.int32)
    penalty[grid] = rules.inside_penalty
    penalty[stops] = rules.sentence_penalty
    penalty[ends] = 0
    places = np.flatnonzero(penalty >= 0)
    return places, penalty[places]


def best_cuts(places: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """The chosen places, of least padding plus penalties; the last place is always one.

    No two neighbouring places may be more than ``length`` apart.
    """
    pos, pen = [0, *places.tolist()], [0, *penalties.tolist()]
    cost, back = [0] * len(pos), [0] * len(pos)
    queue: deque[int] = deque([0])
    keys: deque[int] = deque([0])
    for j in range(1, len(pos)):
        at = pos[j]
        while pos[queue[0]] < at - length:
            queue.popleft()
            keys.popleft()
        back[j] = queue[0]
        cost[j] = cost_j = keys[0] + length - at + pen[j]
        key = cost_j + at
        while keys and keys[-1] >= key:
            keys.pop()
            queue.pop()
        queue.append(j)
        keys.append(key)
    cuts, j = [], len(pos) - 1
    while j > 0:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


def _pieces(docs: list, ids: np.ndarray, ends: np.ndarray, cuts: list[int], number: int, tokens: bool):
    """Rows for each piece of a document in a sequence."""
    ids = ids.astype("<u4")
    start, doc, first = 0, 0, 0
    for k, cut in enumerate(cuts):
        at = start
        while at < cut:
            end = min(cut, int(ends[doc]))
            raw = ids[at:end]
            row = (
                docs[doc], at - first, end - at, zlib.crc32(raw.tobytes()),
                int(ends[doc]) - first, number + k, at - start,
            )
            yield (*row, raw.astype(np.int32)) if tokens else row
            at = end
            if at == ends[doc]:
                first, doc = at, doc + 1
        start = cut


_FIELDS = (
    ("doc_id", "bigint", pa.int64()),
    ("start", "bigint", pa.int64()),
    ("length", "bigint", pa.int64()),
    ("ids_crc32", "bigint", pa.int64()),
    ("doc_tokens", "bigint", pa.int64()),
    ("sequence_id", "bigint", pa.int64()),
    ("offset", "bigint", pa.int64()),
    ("tokens", "array<int>", pa.list_(pa.int32())),
)


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: PackingRules = PackingRules(),
    tokens: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then ``end_id``, so a NULL or empty text is one
    token.  With ``tokens`` the piece's ids are a column, too.  Sequences
    ascend with the documents' order, (doc_id, text); NULL ids come first;
    repeated rows are packed as often as they occur; an empty table gives no
    rows; other columns are not read.  Texts of any length are read whole, long
    ones in pieces, and cut wherever a sequence ends.  Texts are shuffled once,
    by ranges of ids; a range ends a sequence, and a task holds one stretch of
    tokens.
    """
    fields = _FIELDS if tokens else _FIELDS[:-1]
    out = pa.schema([(name, kind) for name, _, kind in fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(rules.ranks)
        sentence = sentence_ends(rules.ranks, rules.end_id)

        def packed(docs, ids, part, number):
            ends = np.cumsum([len(x) for x in ids])
            joined = np.concatenate(ids)
            cuts = best_cuts(*cut_places(joined, ends, sentence, rules), rules.length)
            yield from _pieces(docs, joined, ends, cuts, (part << 40) + number, tokens)
            return number + len(cuts)

        def rows():
            held, ids, size, at, number = [], [], 0, None, 0
            for batch in parts:
                for part, doc, text in zip(*(batch[i].to_pylist() for i in (0, 2, 3)), strict=True):
                    if held and (part != at or size >= rules.stretch):
                        number = yield from packed(held, ids, at, number)
                        held, ids, size = [], [], 0
                    if part != at:
                        at, number = part, 0
                    found = token_ids(encoding, text)
                    found.append(rules.end_id)
                    held.append(doc)
                    ids.append(np.array(found, dtype=np.int32))
                    size += len(found)
            if held:
                yield from packed(held, ids, at, number)

        yield from batches(rows(), out, 2000 if tokens else 20000)

    ddl = ", ".join(f"`{name}` {kind}" for name, kind, _ in fields)
    return ranged(docs, id_col, text_col, with_next=False).mapInArrow(run, ddl)


def op9_packing(docs: DataFrame) -> DataFrame:
    """The contract's columns are those of ``pack_documents``."""
    return pack_documents(docs)
