"""All rules of a chain in one pass over Arrow batches.

Arrow's regexes (RE2) are many times faster than a regex pass of the JVM or of
Python per rule, but know no looks to the side and take ``\\b`` for ASCII.  On
ASCII texts that is Python's meaning, too.  In other texts they tell by a wider
pattern which rules may match, and those are left to Python's ``re``.

While an ASCII text is worked on, control characters stand for a box (one for
each character of a match) and around a match; texts that hold them count as
others.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from inkveil.functions.dialect import to_re2
from inkveil.functions.rules import BOX_MARK, LABEL_MARK, Rule

_BOX, _OPEN, _CLOSE = "\x01", "\x02", "\x03"
# Texts are worked on in slices of so many bytes, of which a few copies are held.
SLICE_BYTES = 1 << 21


class Marked(NamedTuple):
    """Matches of one rule: their row, place and size, and whether they touch an earlier box."""

    row: np.ndarray
    at: np.ndarray
    size: np.ndarray
    touching: np.ndarray


class Chain(NamedTuple):
    """Rules as plain values: RE2's pattern for ASCII texts, its wider one for all, and Python's with its flags."""

    narrow: list[str]
    loose: list[str]
    sources: list[tuple[str, int]]


def arrow_chain(rules: Sequence[Rule], engine: str = "auto") -> Chain | None:
    """The rules for ``arrow_redact``; ``None`` if one of them cannot be spelled."""
    narrow = [to_re2(rule.pattern, rule.case_sensitive) for rule in rules]
    loose = [to_re2(rule.pattern, rule.case_sensitive, loose=True) for rule in rules]
    if engine != "auto" or not rules or None in narrow or None in loose:
        return None
    return Chain(narrow, loose, [(rule.pattern, rule.flags) for rule in rules])


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive parts of a batch, each of about ``SLICE_BYTES`` or one text."""
    if len(texts) == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield texts.slice(first, last - first)
        first = last


def ascii_only(texts: pa.Array) -> np.ndarray:
    """Which texts are ASCII and hold none of the characters written here; not the NULL ones."""
    held = pc.match_substring_regex(texts, f"[{_BOX}-{_CLOSE}]")
    good = pc.and_not(pc.string_is_ascii(texts), held)
    return pc.fill_null(good, False).to_numpy(zero_copy_only=False)


def _marked(texts: pa.Array, pattern: str) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=f"({pattern})", replacement=f"{_OPEN}\\1{_CLOSE}")


def _hits(marked: pa.Array) -> np.ndarray:
    return pc.count_substring(marked, _OPEN).to_numpy()


def _boxed(marked: pa.Array) -> tuple[pa.Array, Marked]:
    """Marked matches as boxes of the same length: the texts, and where the boxes are."""
    _, begins, bytes_ = marked.buffers()
    begins = np.frombuffer(begins, np.int32)[marked.offset : marked.offset + len(marked) + 1].astype(np.int64)
    data = np.frombuffer(bytes_ or b"", np.uint8)[begins[0] : begins[-1]]
    begins = begins - begins[0]
    opened, closed = np.flatnonzero(data == ord(_OPEN)), np.flatnonzero(data == ord(_CLOSE))
    size, start = closed - opened - 1, opened - 2 * np.arange(len(opened))
    data = data[(data != ord(_OPEN)) & (data != ord(_CLOSE))]
    row = np.searchsorted(begins, opened, "right") - 1
    begins = begins - 2 * np.searchsorted(opened, begins)
    before = np.cumsum(size) - size
    places = np.repeat(start - before, size) + np.arange(size.sum())
    touching = np.add.reduceat(data[places] == ord(_BOX), before) > 0 if len(places) else np.zeros(0, bool)
    data[places] = ord(_BOX)
    texts = pa.StringArray.from_buffers(len(marked), pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(data))
    return texts, Marked(row, start - begins[row], size, touching)


def _ascii_part(original: pa.Array, chain: Chain, style: str, listed: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """ASCII texts: what the rules leave, the number of substitutions, and the matches on the original by rule."""
    now, total = original, np.zeros(len(original), np.int32)
    counts = np.zeros((len(original), len(chain.narrow) if listed else 0), np.int32)
    for at, pattern in enumerate(chain.narrow):
        marked = _marked(now, pattern)
        hits = _hits(marked)
        if listed:
            counts[:, at] = hits if now is original else _hits(_marked(original, pattern))
        if not hits.any():
            continue
        total += hits
        if style == "label":
            now = pc.replace_substring_regex(now, pattern=pattern, replacement=LABEL_MARK)
        else:
            now = _boxed(marked)[0]
    if style != "label" and total.any():
        now = pc.replace_substring(now, _BOX, BOX_MARK)
    return now, total, counts


def _other_part(original: pa.Array, chain: Chain, style: str, listed: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The same for other texts, one by one where a rule may match."""
    now, total = original, np.zeros(len(original), np.int32)
    counts = np.zeros((len(original), len(chain.loose) if listed else 0), np.int32)
    mark = LABEL_MARK if style == "label" else (lambda m: BOX_MARK * len(m[0]))
    for at, (loose, source) in enumerate(zip(chain.loose, chain.sources, strict=True)):
        pattern = re.compile(*source)
        if listed:
            for i in _may_match(original, loose):
                counts[i, at] = sum(1 for _ in pattern.finditer(original[i].as_py()))
        changed = {}
        for i in _may_match(now, loose):
            text, n = pattern.subn(mark, now[i].as_py())
            if n:
                changed[int(i)] = text
                total[i] += n
        if changed:
            mask = np.zeros(len(now), bool)
            mask[[*changed]] = True
            now = pc.replace_with_mask(now, pa.array(mask), pa.array([*changed.values()], pa.string()))
    return now, total, counts


def _may_match(texts: pa.Array, loose: str) -> np.ndarray:
    return np.flatnonzero(pc.match_substring_regex(texts, loose).to_numpy(zero_copy_only=False))


def _redacted(texts: pa.Array, chain: Chain, style: str, listed: bool) -> pa.Array:
    """One slice of ``arrow_redact``."""
    good = ascii_only(texts)
    known = pc.is_valid(texts).to_numpy(zero_copy_only=False)
    order = np.concatenate([np.flatnonzero(good), np.flatnonzero(known & ~good), np.flatnonzero(~known)])
    n_good, n_other = int(good.sum()), int((known & ~good).sum())
    dealt = texts.take(pa.array(order))
    done = [
        _ascii_part(_compact(dealt.slice(0, n_good)), chain, style, listed),
        _other_part(_compact(dealt.slice(n_good, n_other)), chain, style, listed),
    ]
    none = len(texts) - n_good - n_other
    total = np.concatenate([done[0][1], done[1][1], np.zeros(none, np.int32)])
    fields = {"text": pa.concat_arrays([done[0][0], done[1][0], pa.nulls(none, pa.string())]), "n": pa.array(total)}
    if listed:
        flat = np.concatenate([done[0][2], done[1][2], np.zeros((none, len(chain.narrow)), np.int32)]).reshape(-1)
        begins = np.arange(0, len(flat) + 1, len(chain.narrow), dtype=np.int32)
        fields["counts"] = pa.ListArray.from_arrays(pa.array(begins), pa.array(flat))
    back = np.argsort(order, kind="stable")
    return pa.StructArray.from_arrays([*fields.values()], names=[*fields]).take(pa.array(back))


def _compact(texts: pa.Array) -> pa.Array:
    """A part of an array as an array of its own, which does not keep the rest."""
    return pa.concat_arrays([texts])


def arrow_redact(chain: Chain, style: str, listed: bool):
    """Arrow UDF: text -> the text that all rules leave and the number of substitutions.

    With ``listed`` also each rule's matches on the original.
    """
    ddl = "text string, n int" + ", counts array<int>" * listed
    kind = pa.struct([("text", pa.string()), ("n", pa.int32()), *[("counts", pa.list_(pa.int32()))] * listed])

    def run(texts: pa.Array) -> pa.Array:
        parts = [_redacted(part, chain, style, listed).cast(kind) for part in slices(texts.cast(pa.string()))]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(run, ddl).asNondeterministic()


SPANS = pa.list_(pa.struct([("rule_no", pa.int32()), *((name, pa.int64()) for name in ("at", "size", "start", "end"))]))


def _spans(texts: pa.Array, chain: Chain, style: str, exact: Callable) -> pa.Array:
    """One slice of ``arrow_spans``."""
    good, found = ascii_only(texts), []
    single = pc.is_valid(texts).to_numpy(zero_copy_only=False)
    if style != "label":
        single &= ~good
        now = pc.if_else(pa.array(good), texts, "")
        for rule_no, pattern in enumerate(chain.narrow, start=1):
            marked = _marked(now, pattern)
            if _hits(marked).any():
                now, boxes = _boxed(marked)
                single[boxes.row[boxes.touching]] = True
                found.append(np.stack([boxes.row, np.full(len(boxes.row), rule_no), boxes.at, boxes.size, boxes.at, boxes.at + boxes.size]))
    own = np.flatnonzero(single)
    left = texts.take(pa.array(own))
    some = np.zeros(len(own), bool)
    for loose in chain.loose:
        some[_may_match(left, loose)] = True
    alone = [(row, *span) for row, i in zip(own[some], np.flatnonzero(some)) for span in exact(left[i].as_py(), chain.sources, style)]
    whole = np.concatenate([*found, np.zeros((6, 0), np.int64)], axis=1)
    whole = whole[:, ~single[whole[0]]]
    whole = np.concatenate([whole, np.array(alone, np.int64).reshape(-1, 6).T], axis=1)
    whole = whole[:, np.argsort(whole[0], kind="stable")]
    begins = np.searchsorted(whole[0], np.arange(len(texts) + 1)).astype(np.int32)
    columns = [pa.array(column.astype(field.type.to_pandas_dtype())) for column, field in zip(whole[1:], SPANS.value_type, strict=True)]
    return pa.ListArray.from_arrays(pa.array(begins), pa.StructArray.from_arrays(columns, fields=[*SPANS.value_type]))


def arrow_spans(chain: Chain, style: str, exact: Callable):
    """Arrow UDF: text -> its substitutions, in order, as ``exact(text, sources, style)`` gives them.

    Boxes do not move a text, so in ASCII texts a match lies where it is found.
    Only texts in which a match touches an earlier box, others than ASCII ones,
    and those with labels are handed to ``exact``, if any rule may match.
    """

    def run(texts: pa.Array) -> pa.Array:
        parts = [_spans(part, chain, style, exact) for part in slices(texts.cast(pa.string()))]
        return pa.concat_arrays(parts) if parts else pa.array([], SPANS)

    return F.arrow_udf(run, "array<struct<rule_no: int, at: bigint, size: bigint, start: bigint, end: bigint>>").asNondeterministic()
