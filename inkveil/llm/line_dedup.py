"""Line dedup: passages that occur again are removed where they occur later.

Every three consecutive lines make a window, and windows overlap; where three
hold fewer than ten words the lines that follow are added.  A window whose hash
occurs twice or more is kept where it stands first, by (doc_id, hash of the
text, position); elsewhere its words count as covered, and neighbouring covered
words are cut out as one stretch.

Prose often has a whole passage on one line, so a physical line is wrapped into
lines: of every ``reach`` consecutive pairs of words on it the one of least hash
is picked, and a picked pair's first word ends a line.  That depends on the
words around alone, so copies of a passage are in step from at most 15 words
behind their beginning on, whatever stands before, and 47 words always hold a
whole window.

What lies before the first window of a stretch or behind its last one is then
compared word by word with what lies there at the first occurrence.  So a
passage goes from its first word to its last.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import WORD, partitions, small_batches, stored
from inkveil.plans.scratch import Staging

@dataclass(frozen=True)
class LineRules:
    """Windows of ``window`` lines; of every ``reach`` pairs of words on a line one is picked.

    Windows with fewer than ``min_words`` words are not compared, as so short a
    sequence occurs in unrelated texts: they are lengthened by the lines that
    follow until they have as many.  At the ends of a stretch ``around`` words
    are compared one by one; beyond a line break fewer than ``over_break`` equal
    ones are taken for chance and stay.  ``filter_bits`` is the logarithm of the size of
    the bit maps that all executors get: 2**26 bits are 8 MB.  ``at_once`` is
    the number of bytes whose words a task holds at a time (or one text).
    """

    window: int = 3
    reach: int = 8
    min_words: int = 10
    around: int = 24
    over_break: int = 3
    filter_bits: int = 26
    at_once: int = 1 << 18


_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), factor, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the factor and of its inverse, as many as any text has needed."""

    def __init__(self) -> None:
        self.up = self.down = _powers(1, 1)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = _powers(_FACTOR, n), _powers(_INVERSE, n)
        return self.up, self.down


_POWERS = _Powers()


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values whose every bit depends on all of the bits given."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def _sliding(pick, values: np.ndarray, size: int) -> np.ndarray:
    have = 1
    while have < size:
        step = min(have, size - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def picked(hashes: np.ndarray, line: np.ndarray, reach: int) -> np.ndarray:
    """A flag for each word: it begins the pair of least hash of some ``reach`` on its physical line."""
    n = len(hashes)
    if n < reach:
        return np.zeros(n, dtype=bool)
    pairs = hashes * np.uint64(_FACTOR)
    same = line[:-1] == line[1:]
    pairs[:-1][same] += hashes[1:][same]
    pairs = mixed(pairs)
    least = _sliding(np.minimum, pairs, reach)
    least[line[: n - reach + 1] != line[reach - 1 :]] = 0
    return _sliding(np.maximum, np.pad(least, reach - 1), reach) == pairs


# A value for each byte, far from those of its neighbours.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_FACTOR))
LONG_WORD = 4096
_AT_A_TIME = 1 << 15  # what is summed stays near the processor


def word_hashes(signs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, from running sums over the bytes of some words at a time."""
    out = np.zeros(len(starts), dtype=np.uint64)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    for i in long:
        out[i] = xxhash.xxh3_64_intdigest(signs[starts[i] : ends[i]].tobytes())
    bounds = np.unique(np.concatenate([[0, len(starts)], long, long + 1]))
    for low, high in zip(bounds[:-1], bounds[1:]):
        if ends[low] - starts[low] > LONG_WORD:
            continue
        while low < high:
            some = min(high, max(low + 1, int(np.searchsorted(ends, starts[low] + _AT_A_TIME, side="right"))))
            first, last = starts[low], ends[some - 1]
            up, down = _POWERS.upto(int(last - first) + 1)
            sums = np.zeros(last - first + 1, dtype=np.uint64)
            np.cumsum(BYTE_VALUES.take(signs[first:last], mode="clip") * up[: last - first], out=sums[1:])
            a, b = starts[low:some] - first, ends[low:some] - first
            out[low:some] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
            low = some
    return out


class Shape(NamedTuple):
    """Texts as lines of words, and the windows that begin with each line.

    ``begins`` and ``ends`` are words by line, ``text`` is its text; the first
    lines of a text have windows, up to ``window_ends`` with hash ``windows``
    (``whole`` where there is one).  ``room`` are the words before and behind
    the window on the physical lines of its ends.  ``sums`` are running sums of
    word hashes, ``places`` where each word begins in its text, in bytes.
    """

    begins: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    whole: np.ndarray
    window_ends: np.ndarray
    windows: np.ndarray
    room: tuple[np.ndarray, np.ndarray]
    sums: np.ndarray
    places: np.ndarray

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of the words from ``start`` to ``end``, wherever they stand."""
        _, down = _POWERS.upto(len(self.sums))
        size = (end - start).astype(np.uint64)
        return mixed((self.sums[end] - self.sums[start]) * down[start] + size)


def shape(texts: Sequence[bytes], rules: LineRules) -> Shape:
    """The lines and windows of several texts, one after another."""
    signs = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    blank = np.ones(len(signs) + 2, dtype=bool)
    blank[1:-1] = (signs == 32) | (signs - np.uint8(9) < 5)
    starts = np.flatnonzero(blank[:-2] & ~blank[1:-1])
    stops = np.flatnonzero(~blank[1:-1] & blank[2:]) + 1
    n = len(starts)
    hashes = word_hashes(signs, starts, stops)
    lines = np.searchsorted(np.flatnonzero(signs == 10), starts)
    _, first, sizes = np.unique(lines, return_index=True, return_counts=True)
    lines = np.repeat(np.arange(len(first)), sizes)
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    owners = np.searchsorted(offsets, starts, side="right") - 1
    stop = picked(hashes, lines, rules.reach)
    breaks = np.cumsum(sizes, dtype=np.int64)
    stop[breaks - 1] = True
    ends = np.flatnonzero(stop) + 1
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
    text = owners[begins]
    up, _ = _POWERS.upto(n + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)])
    last = np.searchsorted(ends, begins + rules.min_words)
    last = np.maximum(last, np.arange(len(ends)) + rules.window - 1)
    whole = last < len(ends)
    last = np.minimum(last, max(len(ends) - 1, 0))
    whole &= text[last] == text
    window_ends = ends[last]
    room = begins - first[lines[begins]], breaks[lines[window_ends - 1]] - window_ends
    out = Shape(begins, ends, text, whole, window_ends, np.zeros(0, dtype=np.uint64), room, sums, starts - offsets[owners])
    return out._replace(windows=out.stretch(begins, window_ends))


def _groups(columns: list[list], rules: LineRules) -> Iterator[tuple[list, list[bytes]]]:
    """Rows (text last) as groups of at most ``at_once`` bytes or one row, with their texts as bytes."""
    rows, texts, size = [], [], 0
    for row in zip(*columns, strict=True):
        raw = row[-1] if isinstance(row[-1], bytes) else row[-1].encode("utf-8", "replace")
        if rows and size + len(raw) > rules.at_once:
            yield rows, texts
            rows, texts, size = [], [], 0
        rows.append(row[:-1])
        texts.append(raw)
        size += len(raw)
    if rows:
        yield rows, texts


def without_words(raw: bytes, starts: np.ndarray, gone: np.ndarray) -> bytes:
    """A text without the words that are gone (by where they start) and the white space behind each stretch of them."""
    parts, end = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    for i, j in edges.reshape(-1, 2):
        parts.append(raw[end : starts[i]])
        end = starts[j] if j < len(starts) else len(raw)
    return b"".join(parts) + raw[end:]


MOST_EDGES = 5000


def _alike(own: Shape, at: np.ndarray, limit: np.ndarray, way: int, first: pa.Array, room: np.ndarray, rules: LineRules) -> np.ndarray:
    """How many words next to each window are those at its first occurrence, by the hashes of the first k.

    ``first`` has a list of these hashes for each place ``at``, ``limit`` is
    where its text ends, ``room`` how many words its physical line has there.
    """
    size = np.asarray(first.value_lengths())
    far = np.arange(1, rules.around + 1)
    there = np.zeros((len(at), rules.around), dtype=np.int32)
    there[far <= size[:, None]] = first.flatten().to_numpy()
    near = at[:, None]
    ends = np.where(far <= np.minimum(size, way * (limit - at))[:, None], near + way * far, near)
    here = own.stretch(near, ends) if way > 0 else own.stretch(ends, near)
    same = (ends != near) & (here.astype(np.int32) == there)
    equal = np.where(same.all(1), rules.around, same.argmin(1))
    return np.where(equal < room + rules.over_break, np.minimum(equal, room), equal)


def cut_texts(texts: Sequence[bytes], ats: pa.Array, more: pa.Array, rules: LineRules) -> Iterator[tuple[bytes, int]]:
    """Each text without its later windows, and the number of lines that lose words.

    ``ats`` are the lines that begin these windows; ``more`` has, for windows
    where a stretch begins or ends, the hashes of the words ``before`` and
    ``behind`` the first occurrence (None where nothing is to be compared).
    """
    own = shape(texts, rules)
    first = np.searchsorted(own.text, np.arange(len(texts) + 1))
    n = len(own.sums) - 1
    words = np.concatenate([own.begins, [n]])[first]
    lines = ats.flatten().to_numpy() + np.repeat(first[:-1], np.asarray(ats.value_lengths()))
    change = np.bincount(own.begins[lines], minlength=n + 1) - np.bincount(own.window_ends[lines], minlength=n + 1)
    owner = np.repeat(np.arange(len(texts)), np.asarray(more.value_lengths().fill_null(0)))
    places = dict(zip(("at", "before", "behind"), more.flatten().flatten()))
    line = first[owner] + places["at"].to_numpy()
    for name, way, at, limit in (("before", -1, own.begins, words[:-1]), ("behind", 1, own.window_ends, words[1:])):
        compared = np.flatnonzero(np.asarray(places[name].is_valid()))
        for i in range(0, len(compared), MOST_EDGES):
            some = compared[i : i + MOST_EDGES]
            here, there = at[line[some]], places[name].take(pa.array(some))
            room = own.room[0 if way < 0 else 1][line[some]]
            far = here + way * _alike(own, here, limit[owner[some]], way, there, room, rules)
            change += np.bincount(np.minimum(here, far), minlength=n + 1) - np.bincount(np.maximum(here, far), minlength=n + 1)
    gone = np.cumsum(change)[:n] > 0
    touched = np.add.reduceat(gone, own.begins) > 0 if len(own.begins) else np.zeros(0, dtype=bool)
    for i, raw in enumerate(texts):
        some = slice(words[i], words[i + 1])
        yield without_words(raw, own.places[some], gone[some]), int(touched[first[i] : first[i + 1]].sum())


_LINES = pa.schema(
    [("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("rest", pa.bool_())]
    + [("windows", pa.binary())]
)
_LINES_DDL = "doc_id bigint, h bigint, n bigint, rest boolean, windows binary"


def _packed(offsets: np.ndarray, hashes: np.ndarray) -> pa.Array:
    """A binary value of 8 bytes a hash for each range that ``offsets`` cut."""
    buffers = [None, pa.py_buffer((8 * offsets).astype("<i4").tobytes()), pa.py_buffer(hashes.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many hashes each value has, and the hashes of all."""
    _, offsets, data = packed.buffers()
    if not len(packed) or data is None:
        return np.zeros(len(packed), dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.frombuffer(offsets, dtype="<i4")[packed.offset : packed.offset + len(packed) + 1]
    return np.diff(at) // 8, np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(np.uint64)


def _lines(keyed: DataFrame, rules: LineRules) -> DataFrame:
    """Each text's number of lines, the hashes of its windows, which its first lines begin, and whether words are left behind the last."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows, texts in _groups([c.to_pylist() for c in part.columns], rules):
                own = shape(texts, rules)
                n = np.bincount(own.text, minlength=len(rows))
                sizes = np.bincount(own.text[own.whole], minlength=len(rows))
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                windows = _packed(offsets, own.windows[own.whole])
                rest = np.zeros(len(rows), dtype=bool)
                some = np.flatnonzero(sizes)
                first = np.cumsum(n) - n
                rest[some] = own.window_ends[(first + sizes - 1)[some]] < own.ends[(first + n - 1)[some]]
                docs, hs = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(hs, pa.int64()), pa.array(n.astype(np.int64)),
                     pa.array(rest), windows], schema=_LINES,
                )
        pa.default_memory_pool().release_unused()

    return keyed.mapInArrow(run, _LINES_DDL)


def _bit_map(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit for the low part of every ``hash``; at most 2**(bits - 6) rows come to the driver."""
    low = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.groupBy(F.shiftright(low, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 AS int))")).alias("bits")
    )
    found = words.toArrow()
    out = np.zeros(max(1, 1 << (bits - 6)), dtype=np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def _shared_map(hashes: DataFrame, rules: LineRules) -> Broadcast:
    return hashes.sparkSession.sparkContext.broadcast(_bit_map(hashes, rules.filter_bits))


_PART_BITS = 14  # of a map: what one row has
_HELD = 1 << 20


def _repeated_map(lines: DataFrame, rules: LineRules) -> Broadcast:
    """A bit for the low part of every window's hash that occurs twice or more.

    A part of the map is a group of hashes; a task packs its hashes of a part
    into one value, none more than twice, and another one finds the repeated
    ones of one part at a time.  The parts come to the driver: the map.
    """
    spark, bits = lines.sparkSession, rules.filter_bits
    part_bits = min(bits, _PART_BITS)
    low = np.uint64((1 << bits) - 1)

    def parts_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0

        def given():
            hashes = np.sort(np.concatenate(kept))
            third = np.zeros(len(hashes), dtype=bool)
            third[2:] = hashes[2:] == hashes[:-2]
            hashes = hashes[~third]
            part = ((hashes & low) >> np.uint64(part_bits)).astype(np.uint32)
            order = np.argsort(part, kind="stable")
            part = part[order]
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            packed = _packed(np.append(starts, len(part)), hashes[order])
            return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), packed], names=["part", "hashes"])

        for batch in parts:
            _, hashes = _unpacked(batch.column(0))
            for i in range(0, len(hashes), _HELD):
                kept.append(hashes[i : i + _HELD].copy())
                held += len(kept[-1])
                if held >= _HELD:
                    yield given()
                    kept, held = [], 0
        if held:
            yield given()
        pa.default_memory_pool().release_unused()

    def repeated(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(part, kept):
            hashes = np.sort(np.concatenate(kept))
            own = np.unique((hashes[1:][hashes[1:] == hashes[:-1]]) & np.uint64((1 << part_bits) - 1))
            words = np.zeros(max(1, 1 << (part_bits - 6)), dtype=np.uint64)
            np.bitwise_or.at(words, (own >> np.uint64(6)).astype(np.int64), np.uint64(1) << (own & np.uint64(63)))
            columns = [pa.array([part], pa.int32()), pa.array([words.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "bits"])

        at, kept = None, []
        for batch in parts:
            sizes, hashes = _unpacked(batch.column(1))
            own, ends = batch.column(0).to_numpy(), np.cumsum(sizes)
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            for i, j in zip(starts, np.append(starts[1:], len(own))):
                if kept and own[i] != at:
                    yield given(at, kept)
                    kept = []
                at = own[i]
                kept.append(hashes[ends[i] - sizes[i] : ends[j - 1]].copy())
        if kept:
            yield given(at, kept)

    dealt = lines.select("windows").mapInArrow(parts_of, "part int, hashes binary").repartition(partitions(spark), "part")
    found = dealt.sortWithinPartitions("part").mapInArrow(repeated, "part int, bits binary").toArrow()
    out = np.zeros((1 << (bits - part_bits), max(1, 1 << (part_bits - 6))), dtype=np.uint64)
    for part, words in zip(found["part"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[part] = np.frombuffer(words, dtype=np.uint64)
    return spark.sparkContext.broadcast(out.ravel())


def _set_in(bits: np.ndarray, hashes: np.ndarray, rules: LineRules) -> np.ndarray:
    low = hashes & np.uint64((1 << rules.filter_bits) - 1)
    return (bits[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1)) == 1


_PLACED = pa.schema(
    [("doc_id", pa.int64()), ("h", pa.int64()), ("at", pa.int32()), ("hash", pa.int64()), ("last", pa.bool_())]
)
_PLACED_DDL = "doc_id bigint, h bigint, at int, hash bigint, last boolean"


def _passing(lines: DataFrame, shared: Broadcast, rules: LineRules) -> DataFrame:
    """The windows whose bit is set in the map; ``last`` marks those that end with their text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for part in parts:
            sizes, flat = _unpacked(part.column("windows"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            first = np.cumsum(sizes) - sizes
            at = np.arange(len(flat)) - np.repeat(first, sizes)
            last = np.zeros(len(flat), dtype=bool)
            rest = part.column("rest").to_numpy(zero_copy_only=False)
            last[(first + sizes - 1)[(sizes > 0) & ~rest]] = True
            hit = _set_in(bits, flat, rules)
            rows = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(rows), part.column("h").take(rows), pa.array(at[hit].astype(np.int32)),
                 pa.array(flat[hit].view(np.int64)), pa.array(last[hit])], schema=_PLACED,
            )

    return lines.select("doc_id", "h", "rest", "windows").mapInArrow(run, _PLACED_DDL)


_AROUND = pa.schema(
    [("doc_id", pa.int64()), ("h", pa.int64()), ("at", pa.int32())]
    + [("before", pa.list_(pa.int32())), ("behind", pa.list_(pa.int32()))]
)
_AROUND_DDL = "doc_id bigint, h bigint, at int, before array<int>, behind array<int>"


def _around(keyed: DataFrame, places: Broadcast, texts: Broadcast, rules: LineRules) -> DataFrame:
    """The words around the windows whose places are in one bit map, of the texts in another.

    Element k is a hash of the k + 1 words next to the window; there are fewer
    at the ends of a text.
    """

    def side(own: Shape, edge: np.ndarray, limit: np.ndarray, way: int) -> pa.Array:
        sizes = np.minimum(way * (limit - edge), rules.around)
        start = np.repeat(edge, sizes)
        far = np.arange(len(start)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        a, b = (start, start + far) if way > 0 else (start - far, start)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(own.stretch(a, b).astype(np.int32)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys = part.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            part = part.filter(pa.array(_set_in(texts.value, keys, rules)))
            columns = [part.column(c).to_pylist() for c in ("doc_id", "h", "key", "text")]
            for rows, raw in _groups(columns, rules):
                own = shape(raw, rules)
                first = np.searchsorted(own.text, np.arange(len(raw)))
                docs, hs, keys = zip(*rows, strict=True)
                places_of = np.array(keys, dtype=np.int64)[own.text] ^ (np.arange(len(own.text)) - first[own.text])
                hit = np.flatnonzero(own.whole & _set_in(places.value, places_of.view(np.uint64), rules))
                behind = np.searchsorted(own.text, np.arange(len(raw)), side="right") - 1
                text = own.text[hit]
                docs, hs = np.array(docs, dtype=object), np.array(hs, dtype=object)
                for i in range(0, len(hit), 5000):
                    some, of = hit[i : i + 5000], text[i : i + 5000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[of], pa.int64()), pa.array(hs[of], pa.int64()),
                         pa.array((some - first[of]).astype(np.int32)),
                         side(own, own.begins[some], own.begins[first[of]], -1),
                         side(own, own.window_ends[some], own.ends[behind[of]], 1)], schema=_AROUND,
                    )
        pa.default_memory_pool().release_unused()

    return keyed.select("doc_id", "h", "text", F.xxhash64("doc_id", "h").alias("key")).mapInArrow(run, _AROUND_DDL)


def repeated_windows(docs: DataFrame, rules: LineRules = LineRules()) -> tuple[DataFrame, DataFrame]:
    """Tables of texts ``(doc_id, h, n)`` and of what goes from them, ``(doc_id, h, ats, more)``.

    ``h`` is the hash of the text: rows alike in doc_id and text are one
    document.  ``ats`` are the lines that begin a later window, ``more`` the
    hashes of words that stand at the first occurrence of some of them.
    Windows are counted by their hash alone, packed per task before; a bit map
    of the repeated ones then lets nearly all others be left out where they
    are, and only what passes it is compared by place.  Where repeats fill the
    map more passes, with the same result.  Of the texts with first occurrences
    of windows in which a stretch begins or ends, the words are read again.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), _hash_of(F.col("text")).alias("h"), F.coalesce("text", F.lit("")).alias("text")
    )
    staging = Staging(docs.sparkSession)  # what nothing reads any more once the places are known
    lines = staging.store(_lines(keyed, rules), "lines")
    windows = staging.store(_passing(lines, _repeated_map(lines, rules), rules), "windows")
    place = F.struct("doc_id", "h", "at")
    firsts = windows.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    # Stored, as a join of two plain shuffles can be split where a hash is hot.
    of_first = {"first_doc": "first.doc_id", "first_h": "first.h", "first_at": "first.at"}
    firsts = staging.store(firsts.select("hash", *[F.col(c).alias(n) for n, c in of_first.items()]), "windows")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("h") == F.col("first_h")) & (F.col("at") == F.col("first_at"))
    later = windows.join(firsts, "hash").filter(~is_first).select("doc_id", "h", "at", "last", *of_first)
    gone, sizes = stored(_by_text(later), "gone"), stored(lines.select("doc_id", "h", "n"), "sizes")
    staging.clear()
    more = _beyond(keyed, gone, rules).groupBy(F.struct("doc_id", "h").alias("key"))
    more = more.agg(F.collect_list(F.struct("at", "before", "behind")).alias("more"))
    ats = gone.select(F.struct("doc_id", "h").alias("key"), "ats")
    return sizes, ats.join(more, "key", "left").select("key.*", "ats", "more")


_LATER = np.dtype(
    [("none", "?"), ("doc", "<i8"), ("h", "<i8"), ("at", "<i4"), ("last", "?")]
    + [("first_none", "?"), ("first_doc", "<i8"), ("first_h", "<i8"), ("first_at", "<i4")]
)
_GONE_DDL = (
    "doc_id bigint, h bigint, ats array<int>, "
    "edges array<struct<at: int, first_doc: bigint, first_h: bigint, first_at: int, begins: boolean, ends: boolean>>"
)
_TEXT_PARTS = 10  # a logarithm
_HELD_ROWS = 1 << 19


def _by_text(later: DataFrame) -> DataFrame:
    """``(doc_id, h, ats, edges)``: the lines that begin a later window, and those where a stretch begins or ends.

    Texts are dealt to parts by the hash of their key.  A task packs what it
    has of a part into one value, a window once; another one gathers the
    windows of the texts of one part at a time.
    """

    def changes(*columns: np.ndarray) -> np.ndarray:
        new = np.zeros(len(columns[0]), dtype=bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return new

    def in_order(cells: np.ndarray) -> np.ndarray:
        """The windows by text and line, each once."""
        cells = cells[np.lexsort([cells[c] for c in ("at", "h", "doc", "none")])]
        return cells[changes(*(cells[c] for c in ("none", "doc", "h", "at")))]

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0

        def given():
            table = pa.Table.from_batches(kept)
            cells = np.zeros(len(table), dtype=_LATER)
            for name in ("h", "at", "last", "first_h", "first_at"):
                cells[name] = table[name].to_numpy()
            for name, none, column in (("doc", "none", "doc_id"), ("first_doc", "first_none", "first_doc")):
                cells[none] = np.asarray(table[column].is_null())
                cells[name] = table[column].fill_null(0).to_numpy()
            cells = in_order(cells)
            part = mixed(cells["h"].view(np.uint64) ^ mixed(cells["doc"].view(np.uint64))) >> np.uint64(64 - _TEXT_PARTS)
            part = part.astype(np.uint16)
            order = np.argsort(part, kind="stable")
            part, cells = part[order], cells[order]
            starts = np.flatnonzero(changes(part))
            offsets = (_LATER.itemsize * np.append(starts, len(cells))).astype("<i4")
            values = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(cells.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), values], names=["part", "cells"])

        for batch in parts:
            kept.append(batch)
            held += len(batch)
            if held >= _HELD_ROWS:
                yield given()
                kept, held = [], 0
        if held:
            yield given()
        pa.default_memory_pool().release_unused()

    def gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(kept: list[bytes]) -> Iterator[pa.RecordBatch]:
            cells = in_order(np.frombuffer(b"".join(kept), dtype=_LATER))
            new = changes(*(cells[c] for c in ("none", "doc", "h")))
            text, at = np.cumsum(new) - 1, cells["at"]
            follows = ~new[1:] & (at[1:] == at[:-1] + 1)
            begins, ends = at > 0, ~cells["last"]
            begins[1:] &= ~follows
            ends[:-1] &= ~follows
            edge = begins | ends
            own, of = cells[edge], np.arange(int(new.sum()) + 1)
            columns = [pa.array(own["at"]), pa.array(own["first_doc"], mask=own["first_none"]), pa.array(own["first_h"]), pa.array(own["first_at"])]
            names = ["at", "first_doc", "first_h", "first_at", "begins", "ends"]
            edges = pa.StructArray.from_arrays([*columns, pa.array(begins[edge]), pa.array(ends[edge])], names=names)
            lists = [
                pa.ListArray.from_arrays(pa.array(np.searchsorted(texts, of).astype(np.int32)), values)
                for texts, values in ((text, pa.array(at)), (text[edge], edges))
            ]
            keys = [pa.array(cells["doc"][new], mask=cells["none"][new]), pa.array(cells["h"][new])]
            whole = pa.RecordBatch.from_arrays([*keys, *lists], names=["doc_id", "h", "ats", "edges"])
            yield from (whole.slice(i, 5000) for i in range(0, len(whole), 5000))

        at, kept = None, []
        for batch in parts:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if kept and part != at:
                    yield from given(kept)
                    kept = []
                at = part
                kept.append(cells)
        if kept:
            yield from given(kept)

    dealt = later.mapInArrow(packed, "part int, cells binary").repartition(partitions(later.sparkSession), "part")
    return dealt.sortWithinPartitions("part").mapInArrow(gathered, _GONE_DDL)


def _beyond(keyed: DataFrame, gone: DataFrame, rules: LineRules) -> DataFrame:
    """``(doc_id, h, at, before, behind)``: where a stretch begins or ends, the words next to the first occurrence."""

    first = F.struct(F.col("first_doc").alias("doc_id"), F.col("first_h").alias("h"), F.col("first_at").alias("at"))
    edges = gone.select("doc_id", "h", F.inline("edges")).select("doc_id", "h", "at", first.alias("first"), "begins", "ends")
    edges = stored(edges, "edges")
    places = stored(edges.select("first").distinct().select("first.*"), "edges")
    key = F.xxhash64("doc_id", "h")
    maps = (
        _shared_map(places.select(key.bitwiseXOR(F.col("at").cast("bigint")).alias("hash")), rules),
        _shared_map(places.select(key.alias("hash")), rules),
    )
    first = F.struct("doc_id", "h", "at").alias("first")  # never NULL, so that NULL ids meet
    around = _around(keyed, *maps, rules).select(first, "before", "behind").dropDuplicates(["first"])
    # Stored, as a join of two plain shuffles can be split where a place is hot.
    return edges.join(stored(around, "around"), "first").select(
        "doc_id", "h", "at", F.when(F.col("begins"), F.col("before")).alias("before"), F.when(F.col("ends"), F.col("behind")).alias("behind")
    )


def _hash_of(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def dedup_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` with the cut ``text``, and ``n_lines`` and ``n_removed`` (lines that lost words) per row.

    A NULL text stays NULL and has no lines; texts of fewer than three lines
    have no windows and stay; NULL ids come before all others; rows alike in
    doc_id and text are one document and are cut alike; of equal texts with
    different ids the least id keeps its words; an empty table stays empty.
    A text of any length is read whole, a few megabytes of others with it.  All
    other columns are kept as they are, whatever their names (``n_lines`` and
    ``n_removed`` are replaced).  Texts are shuffled once, by their hash.
    """
    lines, gone = repeated_windows(docs, rules)
    key = F.struct("doc_id", "h").alias("key")  # never NULL, so that NULL ids meet
    sizes = lines.groupBy("doc_id", "h").agg(F.max("n").alias("n"))
    found = sizes.select(key, "n").join(gone.select(key, "ats", "more"), "key", "left")

    def apply(texts: pa.Array, ats: pa.Array, more: pa.Array) -> pa.Array:
        left: list[bytes | None] = [None] * len(texts)
        lost = np.zeros(len(texts), dtype=np.int64)
        hit = np.flatnonzero(np.asarray(texts.is_valid()) & np.asarray(ats.is_valid()))
        rows, done = pa.array(hit), 0
        texts, ats, more = texts.take(rows), ats.take(rows), more.take(rows)
        for some, raw in _groups([hit.tolist(), texts.cast(pa.binary()).to_pylist()], rules):
            cuts = cut_texts(raw, ats.slice(done, len(raw)), more.slice(done, len(raw)), rules)
            for (i,), (text, n) in zip(some, cuts, strict=True):
                left[i], lost[i] = text, n
            done += len(raw)
        return pa.StructArray.from_arrays([pa.array(left, pa.binary()).cast(pa.string()), pa.array(lost)], names=["text", "n"])

    # Texts that stay are not sent to Python.  Both results come from one call:
    # an expression that counts as nondeterministic is not copied into each use.
    cutter = F.arrow_udf(apply, "text string, n bigint").asNondeterministic()
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    own = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), _hash_of(F.col("text")).alias("h")).alias("key")
    joined = docs.select(row, own).join(found, "key", "left")
    done = joined.withColumn("cut", cutter(F.when(F.col("ats").isNotNull(), F.col("row.text")), F.col("ats"), F.col("more")))
    text = F.when(F.col("ats").isNotNull(), F.col("cut.text")).otherwise(F.col("row.text"))
    return done.select(
        *[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in kept],
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce("cut.n", F.lit(0)).cast("bigint").alias("n_removed"),
    )


def op5_line_dedup(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, n_lines, n_removed)`` of every document."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")


def without_repeats(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` with cut texts, without the documents of which nothing is left.

    ``n_chars`` follows the text.  A document that had no words before stays.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept")
    done = dedup_lines(docs.select("doc_id", "text", kept), rules)
    left = done.filter((F.col("n_removed") == 0) | F.regexp_like("text", F.lit(WORD)))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return left.select(
        *[(own[c] if c in own else F.col("kept").getField(c)).alias(c) for c in docs.columns]
    )
