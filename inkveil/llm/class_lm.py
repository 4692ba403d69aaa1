"""LM scoring: a Brown class-based bigram model.

All training words are put into classes by exchange clustering on their bigram
counts: a word moves to the class that raises the likelihood of the training
text most.  The most frequent words are exchanged one by one to seed the
classes; then whole rounds follow in which Spark gathers, for every word, how
often it stands next to each class, and each word picks its class against the
same class table.  A round that does not raise the likelihood is taken back.
Only words unseen in training are known by their ending.  A text's probability
is the product of class-transition and word-emission probabilities,

    P(w | v) = P(class(w) | class(v)) P(w | class(w)),

both smoothed.  Counts cover every word of all training texts.  Numbers and
classes of the words up to a bounded number of most frequent ones go to every
task; the counts and classes of all others are found by joins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import partitions, small_batches, stored


@dataclass(frozen=True)
class ClassModel:
    """Words are exchanged among ``classes + endings`` classes.

    ``seeds`` words are exchanged one by one among the first ``classes``, the
    others start in one of the ``endings`` classes by their last two bytes.
    ``rounds`` of exchange of listed words follow (the first of those that are
    no seeds, then of every second word in turn), and one of the words beyond.  ``listed`` bounds the words whose numbers every task holds (about
    40 MB).  A task holds counts of ``held_words`` words, or of ``held_cells``
    pairs of a listed word and a class, before it passes them on.
    """

    seeds: int = 1024
    classes: int = 96
    endings: int = 16
    listed: int = 1 << 18
    sweeps: int = 6
    rounds: int = 3
    add: float = 0.1
    add_class: float = 0.5
    held_words: int = 200_000
    held_cells: int = 1 << 20


def held_out(id_col: Column) -> Column:
    """Every tenth document by crc32 of its id as text; a NULL id counts as an empty text."""
    text = F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")
    return F.crc32(text) % 10 == 0


AT_ONCE = 1 << 22


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and the words of all in order, A-Z in lower case."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    some = np.asarray(pc.binary_length(flat)) > 0  # white space at either end leaves an empty piece
    before = np.concatenate([[0], np.cumsum(some)])[offsets - offsets[0]]
    return np.diff(before), flat.filter(pa.array(some)).cast(pa.binary())


def _slices_of_texts(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows (text last) in slices of at most ``AT_ONCE`` bytes or one text."""
    ends = np.cumsum(np.asarray(pc.binary_length(part.column(part.num_columns - 1))), dtype=np.int64)
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
        yield part.slice(begin, stop - begin)
        begin = stop


def word_counts(docs: DataFrame, model: ClassModel) -> DataFrame:
    """``(word, n)`` over the texts; every task sums before it passes counts on."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0

        def summed():
            whole = pa.concat_tables(kept).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return whole.select(["word", "n_sum"]).rename_columns(["word", "n"])

        for part in parts:
            for some in _slices_of_texts(part):
                found = _words(some.column(0))[1].value_counts()
                kept.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                held += len(found)
                if held > 2 * model.held_words:
                    kept = [summed()]
                    held = len(kept[0])
                    if held > model.held_words:
                        yield from kept.pop().to_batches(max_chunksize=20_000)
                        held = 0
        if kept:
            yield from summed().to_batches(max_chunksize=20_000)
        pa.default_memory_pool().release_unused()

    each = docs.select("text").mapInArrow(run, "word binary, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def ending(word: bytes, endings: int) -> int:
    return zlib.crc32(word[-2:]) % endings


# A word that is not listed has the number -1 - tail: its last byte, or 256 and its last two.
TAILS = 256 + 65_536


def _tails(words: pa.Array) -> np.ndarray:
    ends, signs = _binary(words)
    size = np.diff(ends)
    last = signs[ends[1:] - 1].astype(np.int32)
    return np.where(size > 1, 256 + 256 * signs[np.maximum(ends[1:] - 2, 0)].astype(np.int32) + last, last)


@lru_cache(maxsize=4)
def _tail_endings(endings: int) -> np.ndarray:
    """The ending of every tail."""
    tails = [bytes([i]) for i in range(256)] + [i.to_bytes(2, "big") for i in range(65_536)]
    return np.array([ending(t, endings) for t in tails], dtype=np.int32)


def _binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the binary values begins (and the last one ends), and the bytes of all."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, dtype="<i4")[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, "<i4")
    return at, np.frombuffer(data or b"", dtype=np.uint8)


def _binary_array(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values from where they begin in bytes."""
    buffers = [None, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(data.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def encoded_texts(docs: DataFrame, shared) -> DataFrame:
    """Texts as numbers of listed words (below 0: another word) and the other words in order."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array(shared.value, pa.binary())  # not kept: workers go on to other stages
        for part in parts:
            for some in _slices_of_texts(part):
                counts, words = _words(some.column("text"))
                found = pc.index_in(words, value_set=listed)
                other = np.asarray(pc.is_null(found))
                rare = words.filter(pa.array(other))
                at = np.asarray(found.fill_null(0)).astype("<i4")
                at[other] = -1 - _tails(rare)
                ends = np.concatenate([[0], np.cumsum(counts)])
                of_rare = np.concatenate([[0], np.cumsum(other)])[ends].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("h"), _binary_array(4 * ends, at), pa.ListArray.from_arrays(of_rare, rare)],
                    names=["doc_id", "h", "ids", "rare"],
                )
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "h", "text").mapInArrow(
        run, "doc_id bigint, h bigint, ids binary, rare array<binary>"
    )


Run = tuple[np.ndarray, list[bytes]]
MOST_IN_RUN = 1 << 17


def text_runs(ids: bytes, rare: list[bytes], end: int) -> Iterator[Run]:
    """A text in runs of bounded length; an ``end`` follows its last word."""
    all_at, used = np.frombuffer(ids, dtype="<i4"), 0
    for i in range(0, len(all_at) + 1, MOST_IN_RUN):
        at = all_at[i : i + MOST_IN_RUN].astype(np.int64)
        others = int((at < 0).sum())
        if i + MOST_IN_RUN > len(all_at):
            at = np.append(at, end)
        yield at, rare[used : used + others]
        used += others


def _with_ends(ids: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all texts, with an ``end`` behind each; and where these ends are."""
    offsets, raw = _binary(ids)
    numbers = raw[offsets[0] : offsets[-1]].view("<i4")
    ends = (offsets[1:] - offsets[0]) // 4 + np.arange(len(ids))
    out = np.full(len(numbers) + len(ids), end, dtype=np.int32)
    of_words = np.ones(len(out), dtype=bool)
    of_words[ends] = False
    out[of_words] = numbers
    return out, ends


def token_runs(parts: Iterator[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
    """All texts of ``(ids)`` as runs, each beginning with the last token of the one before."""
    last = np.array([end], dtype=np.int32)
    for part in parts:
        at, _ = _with_ends(part.column(0), end)
        for i in range(0, len(at), MOST_IN_RUN):
            whole = np.concatenate([last, at[i : i + MOST_IN_RUN]])
            yield whole
            last = whole[-1:]


@dataclass(frozen=True)
class Classes:
    """The class of every listed word, by number; the last one is the end of a text."""

    label: np.ndarray
    first_ending: int
    endings: int

    @property
    def end(self) -> int:
        return len(self.label) - 1

    @property
    def size(self) -> int:
        return self.first_ending + self.endings + 1

    @property
    def end_class(self) -> int:
        return int(self.label[-1])

    @cached_property
    def _by_number(self) -> np.ndarray:
        """Classes by number; those of tails, from the back, by numbers below 0."""
        tails = self.first_ending + _tail_endings(self.endings)[::-1]
        return np.concatenate([self.label, tails]).astype(np.int64)

    def of(self, at: np.ndarray) -> np.ndarray:
        """Classes along a run; words that are not listed stand in that of their ending."""
        return self._by_number[at]


def seed_bigrams(texts: DataFrame, symbols, size: int) -> np.ndarray:
    """Counts of neighbouring symbols, a bounded matrix; ``symbols``: a broadcast ``Classes``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = symbols.value
        total = np.zeros(size**2, dtype=np.int64)
        for at in token_runs(parts, own.end):
            chain = own.of(at)
            total += np.bincount(chain[:-1] * size + chain[1:], minlength=size**2)
        yield from _table_rows(total[:, None])

    return _table(texts.select("ids").mapInArrow(run, "pair bigint, n0 bigint"), size, 1)[0]


def class_tables(texts: DataFrame, shared, size: int) -> np.ndarray:
    """Two tables of neighbouring classes: over all words, and between listed ones alone."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros((size**2, 2), dtype=np.int64)
        for at in token_runs(parts, own.end):
            chain = own.of(at)
            pairs = chain[:-1] * size + chain[1:]
            total[:, 0] += np.bincount(pairs, minlength=size**2)
            total[:, 1] += np.bincount(pairs[(at[:-1] >= 0) & (at[1:] >= 0)], minlength=size**2)
        yield from _table_rows(total)

    return _table(texts.select("ids").mapInArrow(run, "pair bigint, n0 bigint, n1 bigint"), size, 2)


def _table_rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    found = np.flatnonzero(total[:, 0])
    names = ["pair"] + [f"n{i}" for i in range(total.shape[1])]
    for i in range(0, len(found), 50_000):
        some = found[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some)] + [pa.array(c) for c in total[some].T], names=names)


def _table(rows: DataFrame, size: int, tables: int) -> np.ndarray:
    """Sums of ``(pair, n0, ...)`` as matrices; at most ``size`` squared rows reach the driver."""
    got = rows.groupBy("pair").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(tables)]).toArrow()
    out = np.zeros((tables, size**2))
    for i in range(tables):
        out[i, got["pair"].to_numpy()] = got[f"n{i}"].to_numpy()
    return out.reshape(tables, size, size)


_CELL = np.dtype([("ctx", "<u2"), ("n", "<u2")])


def listed_cells(texts: DataFrame, shared, size: int, turn: tuple[int, int, int], model: ClassModel) -> DataFrame:
    """``(at, cells)``, sorted: how often each class stands left (ctx) and right (size + ctx) of a word.

    Of the words from ``turn[0]`` on those with ``turn[1]`` as the remainder
    by ``turn[2]`` are counted.  A task packs its counts of a word into one
    value, so a word comes in about as many rows as there are tasks.
    """
    out = pa.schema([("at", pa.int32()), ("cells", pa.binary())])
    first, remainder, divisor = turn

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        moving = np.arange(own.end + 1) % divisor == remainder
        moving[:first] = moving[own.end] = False
        keys, sums, held = [], [], 0

        def given(values, n):
            for i in range(0, len(values), 200_000):
                yield _packed(values[i : i + 200_000], n[i : i + 200_000], size, out)

        for at in token_runs(parts, own.end):
            chain = own.of(at)
            word = (at >= 0) & moving[np.maximum(at, 0)]
            at = at.astype(np.int64)
            left = (at[1:] * 2 * size + chain[:-1])[word[1:]]
            right = (at[:-1] * 2 * size + size + chain[1:])[word[:-1]]
            values, n = np.unique(np.concatenate([left, right]), return_counts=True)
            keys.append(values)
            sums.append(n)
            held += len(values)
            if held > model.held_cells:
                values, n = _summed(keys, sums)
                keys, sums, held = [values], [n], len(values)
                if held > model.held_cells // 2:
                    yield from given(values, n)
                    keys, sums, held = [], [], 0
        if keys:
            yield from given(*_summed(keys, sums))

    rows = texts.select("ids").mapInArrow(run, "at int, cells binary")
    return rows.repartition(partitions(texts.sparkSession), "at").sortWithinPartitions("at")


def _summed(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, in the order of keys."""
    values = np.concatenate(keys)
    order = np.argsort(values, kind="stable")
    values = values[order]
    starts = np.flatnonzero(np.diff(values, prepend=-1))
    return values[starts], np.add.reduceat(np.concatenate(sums)[order], starts) if len(starts) else starts


def _packed(keys: np.ndarray, n: np.ndarray, size: int, schema: pa.Schema) -> pa.RecordBatch:
    """Sorted keys ``at * 2 * size + ctx`` as one row per word; counts beyond 65,535 take several cells."""
    times = (n + 65_534) // 65_535
    keys, n = np.repeat(keys, times), np.repeat(n, times)
    cells = np.empty(len(keys), dtype=_CELL)
    cells["ctx"] = keys % (2 * size)
    cells["n"] = 65_535
    last = np.cumsum(times) - 1
    cells["n"][last] = n[last] - 65_535 * (times - 1)
    at = keys // (2 * size)
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    offsets = (np.append(starts, len(at)) * _CELL.itemsize).astype(np.int32)
    packed = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(cells.tobytes())]
    )
    return pa.RecordBatch.from_arrays([pa.array(at[starts].astype(np.int32)), packed], schema=schema)


def best_listed(cells: DataFrame, table, shared) -> DataFrame:
    """``(at, cls)``: each counted word's best class; what a task holds are the cells of a few thousand words."""
    out = pa.schema([("at", pa.int32()), ("cls", pa.int32())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bigrams, label = table.value, shared.value.label
        width, gains = 2 * len(bigrams), Gains(bigrams)

        def chosen(keys, n):
            at, ctx = keys // width, keys % width
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            for i, j in _slices(np.append(starts[1:], len(at))):
                low, high = starts[i], starts[j] if j < len(starts) else len(at)
                some = at[starts[i:j]]
                best = best_classes(bigrams, label[some], ctx[low:high], n[low:high].astype(float), starts[i:j] - low, gains)
                columns = [pa.array(some.astype(np.int32)), pa.array(best.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

        keys, sums, held = [], [], 0
        for part in parts:
            lengths = pc.binary_length(part.column(1)).to_numpy() // _CELL.itemsize
            flat = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=_CELL)
            keys.append(np.repeat(part.column(0).to_numpy().astype(np.int64), lengths) * width + flat["ctx"])
            sums.append(flat["n"].astype(np.int64))
            held += len(flat)
            if held > 1 << 17:
                values, n = _summed(keys, sums)
                whole = int(np.searchsorted(values, values[-1] // width * width))  # the last word may go on
                yield from chosen(values[:whole], n[:whole])
                keys, sums, held = [values[whole:]], [n[whole:]], len(values) - whole
        if held:
            yield from chosen(*_summed(keys, sums))

    return cells.mapInArrow(run, "at int, cls int")


def _slices(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words that have 2,048 cells or one word; ``ends``: where each word's cells end."""
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + 2048, side="right")))
        yield begin, stop
        begin = stop


def rare_places(texts: DataFrame, shared, size: int) -> DataFrame:
    """``(word, l, r)``, sorted, of words that are not listed: the class on the left, and on the right.

    On the right it is size + the class, or 2 size + it if such a word stands
    there.  No such word has more places than the least frequent listed one.
    """
    out = pa.schema([("word", pa.binary()), ("l", pa.int32()), ("r", pa.int32())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in parts:
            at, _ = _with_ends(part.column(0), own.end)
            words = part.column(1).flatten()
            where = np.flatnonzero(at < 0)
            for i in range(0, len(where), 20_000):
                some = where[i : i + 20_000]
                right = at[some + 1]  # a text's last word has its end there
                l = np.where(some > 0, own.of(at[some - 1]), own.end_class)
                r = own.of(right) + np.where(right < 0, 2 * size, size)
                columns = [words.slice(i, len(some)), pa.array(l.astype(np.int32)), pa.array(r.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    places = texts.select("ids", "rare").mapInArrow(run, "word binary, l int, r int")
    return places.repartition(partitions(texts.sparkSession), "word").sortWithinPartitions("word")


_RARE_CELL = np.dtype([("ctx", "<i4"), ("n", "<i8")])
MOST_HELD = 1 << 17


def _rare_sums(parts: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Words, and sums ``word * width + ctx`` of their cells; a word that goes on is kept as its sums."""
    last, keys, sums = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept, held = [], 0

    def grouped():
        whole = pa.Table.from_batches(kept).combine_chunks()
        words = pa.concat_arrays([last, *whole.column(0).chunks])
        new = np.ones(len(words), dtype=bool)
        new[1:] = np.asarray(pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)))
        number = (np.cumsum(new) - 1)[len(last) :] * width
        places = [keys, *(number + whole.column(c).to_numpy() for c in (1, 2))]
        return words.filter(pa.array(new)), *_summed(places, [sums, np.ones(2 * len(number), dtype=np.int64)])

    for part in parts:
        kept.append(part)
        held += len(part)
        if held > MOST_HELD:
            words, values, n = grouped()
            ready, kept, held = len(words) - 1, [], 0
            whole = int(np.searchsorted(values, ready * width))
            if ready:
                yield words.slice(0, ready), values[:whole], n[:whole]
            last, keys, sums = words.slice(ready), values[whole:] - ready * width, n[whole:]
    if kept:
        yield grouped()
    elif len(last):
        yield last, keys, sums


class Gains:
    """What counts from 0 to ``most`` add to the likelihood of a class table, worked out once."""

    most = 32

    def __init__(self, table: np.ndarray):
        k = len(table) - 1
        n = np.arange(self.most + 1.0)
        self.near = np.concatenate([table[:, :k], table[:k].T])  # by context: a class on the left, on the right
        self.near_gain = self._all(self.near, n[:, None, None]).reshape(-1, k)
        self.sums = np.stack([table.sum(0)[:k], table.sum(1)[:k]])
        self.sums_gain = self._all(self.sums, n[:, None, None])

    @staticmethod
    def _all(base: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _xlogx(base + n) - _xlogx(base)

    def of_cells(self, row: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = np.minimum(n, self.most).astype(np.int64) * len(self.near) + row
        out = self.near_gain[at]
        more = np.flatnonzero(n > self.most)
        out[more] = self._all(self.near[row[more]], n[more, None])
        return out

    def of_sums(self, side: int, n: np.ndarray) -> np.ndarray:
        out = self.sums_gain[np.minimum(n, self.most).astype(np.int64), side]
        more = np.flatnonzero(n > self.most)
        out[more] = self._all(self.sums[side], n[more, None])
        return out


def best_classes(
    table: np.ndarray, own: np.ndarray, ctx: np.ndarray, n: np.ndarray, starts: np.ndarray, gains: Gains | None = None
) -> np.ndarray:
    """The class of highest likelihood for each word, given the class bigrams of all others.

    The cells of word i begin at ``starts[i]``; ``own`` is its class in
    ``table`` (a word next to itself counts as next to another of its class), or -1 if its counts are not to be taken out.  A tie with the
    own class stays, other ties go to the lower class.
    """
    gains = gains or Gains(table)
    size = len(table)
    k = size - 1  # all but the end
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ctx))))
    left, c = ctx < size, ctx % size
    inner = c < k
    cell = ((~left).astype(np.int64) * len(starts) + owner) * k + c
    near = np.bincount(cell[inner], weights=n[inner], minlength=2 * len(starts) * k)
    near = near.reshape(2, len(starts), k)  # by word: counts of classes on its left, its right
    has = np.flatnonzero(own >= 0)

    row = np.where(left, c, size + c)
    gain = gains.of_cells(row, n)
    # The table without the word: its own class loses what stands next to it.
    mine = np.flatnonzero(own[owner] >= 0)
    base = gains.near[row[mine], own[owner[mine]]] - n[mine]
    gain[mine, own[owner[mine]]] = Gains._all(np.maximum(base, 0), n[mine])
    in_own = np.flatnonzero(c == own[owner])
    base = gains.near[row[in_own]]
    base[np.arange(len(in_own)), own[owner[in_own]]] -= n[in_own]
    base -= near[left[in_own].astype(int), owner[in_own]]
    gain[in_own] = Gains._all(np.maximum(base, 0), n[in_own, None])
    gain = np.add.reduceat(gain, starts, axis=0)
    # Where a class stands on both sides, one count of the table takes both.
    word, both = np.nonzero((near[0] > 0) & (near[1] > 0))
    l, r = near[0, word, both], near[1, word, both]
    d = np.maximum(table[both, both] - np.where(own[word] == both, l + r, 0), 0)
    gain[word, both] += _xlogx(d + l + r) - _xlogx(d + l) - _xlogx(d + r) + _xlogx(d)
    for i, side in enumerate((left, ~left)):
        amount = np.bincount(owner, weights=n * side, minlength=len(starts))
        lost = gains.of_sums(i, amount)
        rest = np.maximum(gains.sums[i, own[has]] - amount[has], 0)
        lost[has, own[has]] = Gains._all(rest, amount[has])
        gain -= lost
    gain[has, own[has]] += 1e-9
    return gain.argmax(1)


def best_rare(places: DataFrame, table) -> DataFrame:
    """``(word, n, cls, cells)``: each word's count and best class, with its cells (at most three per class)."""
    out = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("cls", pa.int32()), ("cells", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bigrams = table.value
        width, gains = 3 * len(bigrams), Gains(bigrams)
        for words, keys, sums in _rare_sums(parts, width):
            ctx, n = keys % width, sums.astype(float)
            starts = np.searchsorted(keys, np.arange(len(words)) * width)
            ends = np.append(starts[1:], len(keys))
            best = np.zeros(len(words), dtype=np.int32)
            for i, j in _slices(ends):
                low, high = starts[i], ends[j - 1]
                best[i:j] = best_classes(bigrams, np.full(j - i, -1), ctx[low:high], n[low:high], starts[i:j] - low, gains)
            seen = np.add.reduceat(sums * (ctx < len(bigrams)), starts)
            cells = np.empty(len(keys), dtype=_RARE_CELL)
            cells["ctx"], cells["n"] = ctx, sums
            packed = _binary_array(_RARE_CELL.itemsize * np.append(starts, len(keys)), cells)
            whole = pa.RecordBatch.from_arrays([words, pa.array(seen), pa.array(best), packed], schema=out)
            yield from (whole.slice(i, 20_000) for i in range(0, len(words), 20_000))

    return places.mapInArrow(run, "word binary, n bigint, cls int, cells binary")


def rare_table(words: DataFrame, size: int) -> np.ndarray:
    """Class bigrams with a word that is not listed; left of another such word it counts by its ending."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size**2, 1), dtype=np.int64)
        for part in parts:
            ends, raw = _binary(part.column(1))
            flat = raw[ends[0] : ends[-1]].view(_RARE_CELL)
            ctx, n = flat["ctx"].astype(np.int64), flat["n"]
            cls = np.repeat(part.column(0).to_numpy().astype(np.int64), np.diff(ends) // _RARE_CELL.itemsize)
            for side, pairs in ((ctx < size, ctx * size + cls), (ctx // size == 1, cls * size + ctx % size)):
                total[:, 0] += np.bincount(pairs[side], weights=n[side], minlength=size**2).astype(np.int64)
        yield from _table_rows(total)

    return _table(words.select("cls", "cells").mapInArrow(run, "pair bigint, n0 bigint"), size, 1)[0]


def likelihood(table: np.ndarray) -> float:
    """What of the log-likelihood depends on the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, clustered: int, classes: int, sweeps: int) -> np.ndarray:
    """A class for every symbol: 0..classes-1 for the clustered, one of its own for each other.

    Maximises sum n(a,b) log n(a,b) - sum n(a) log n(a) - sum n(b) log n(b)
    over class bigrams; words move one by one, most frequent first, until a
    sweep moves none or ``sweeps`` are done.
    """
    size = len(bigrams)
    classes = max(1, min(classes, clustered))
    label = np.concatenate([np.arange(clustered) % classes, classes + np.arange(size - clustered)])
    n_labels = classes + size - clustered
    member = np.zeros((size, n_labels))
    member[np.arange(size), label] = 1
    table = member.T @ bigrams @ member
    rows, cols = table.sum(1), table.sum(0)
    right, left = bigrams @ member, bigrams.T @ member  # by word: counts to and from classes
    for _ in range(sweeps):
        moved = 0
        for w in range(clustered):
            a, own = label[w], bigrams[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[a] -= own
            l[a] -= own
            out, into = r.sum() + own, l.sum() + own
            table[a] -= r
            table[:, a] -= l
            table[a, a] -= own
            rows[a] -= out
            cols[a] -= into
            rows -= l
            cols -= r
            # Counts of the neighbours towards w are put back by the class it goes to.
            near = np.arange(classes)
            by_row = _xlogx(table[:classes] + r) - _xlogx(table[:classes])
            by_col = _xlogx(table[:, :classes] + l[:, None]) - _xlogx(table[:, :classes])
            diagonal = table[near, near]
            gain = by_row.sum(1) - by_row[near, near] + by_col.sum(0) - by_col[near, near]
            gain += _xlogx(diagonal + r[:classes] + l[:classes] + own) - _xlogx(diagonal)
            gain -= _xlogx(rows[:classes] + l[:classes] + out) - _xlogx(rows[:classes] + l[:classes])
            gain -= _xlogx(cols[:classes] + r[:classes] + into) - _xlogx(cols[:classes] + r[:classes])
            b = int(np.argmax(gain + 1e-9 * (near == a)))
            rows += l
            cols += r
            table[b] += r
            table[:, b] += l
            table[b, b] += own
            rows[b] += out
            cols[b] += into
            if b != a:
                label[w] = b
                moved += 1
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
        if not moved:
            break
    return label


@dataclass(frozen=True)
class Trained:
    """What scoring needs: per listed word (the last is the end) and per class, in base-10 logarithms."""

    classes: Classes
    transition: np.ndarray  # log P(class | class before)
    emission: np.ndarray  # log P(word | class)
    smoothed: np.ndarray  # log of a class's smoothed total
    base: np.ndarray  # log P(word)
    base_total: float  # log of N + add (V + 1)
    end_known: bool


def train(texts: DataFrame, words: list[bytes], counts: np.ndarray, model: ClassModel) -> tuple[Classes, np.ndarray, DataFrame]:
    """Classes of the listed words, their transition counts, and ``(word, n, cls, cells)`` of all others."""
    spark = texts.sparkSession
    share = spark.sparkContext.broadcast
    seeds = min(model.seeds, len(words))
    late = [seeds + ending(w, model.endings) for w in words[seeds:]]
    end = seeds + model.endings
    symbols = Classes(np.concatenate([np.arange(seeds), late, [end]]).astype(np.int64), seeds, model.endings)
    found = exchange(seed_bigrams(texts, share(symbols), end + 1), seeds, model.classes, model.sweeps)
    classes = Classes(found[symbols.label], int(found[end]) - model.endings, model.endings)

    size = classes.size
    shared = share(classes)
    tables = class_tables(texts, shared, size)
    for turn in range(model.rounds):
        # Words that all move at once may crowd one class: seeds wait for the others, then every second word moves.
        moving = (0, turn % 2, 2) if turn else (seeds, 0, 1)
        cells = listed_cells(texts, shared, size, moving, model)
        moved = best_listed(cells, share(tables[0]), shared).toArrow()
        label = classes.label.copy()
        label[moved["at"].to_numpy()] = moved["cls"].to_numpy()
        tried = Classes(label, classes.first_ending, classes.endings)
        tried_shared = share(tried)
        after = class_tables(texts, tried_shared, size)
        if likelihood(after[0]) <= likelihood(tables[0]):
            break
        classes, shared, tables = tried, tried_shared, after
    others = stored(best_rare(rare_places(texts, shared, size), share(tables[0])), "classes")
    return classes, tables[1] + rare_table(others, size), others


_SCORED = [
    *(pa.field(c, pa.int64()) for c in ("doc_id", "h", "n_tokens", "n_known")),
    *(pa.field(c, pa.float64()) for c in ("base", "score")),
    *(pa.field(c, pa.int64()) for c in ("n_rare", "n")),
    *(pa.field(c, pa.binary()) for c in ("word", "next")),
    *(pa.field(c, pa.int32()) for c in ("lc", "rc")),
]
_SCORED_DDL = (
    "doc_id bigint, h bigint, n_tokens bigint, n_known bigint, base double, score double, n_rare bigint, "
    "n bigint, word binary, next binary, lc int, rc int"
)


def score_listed(texts: DataFrame, trained) -> DataFrame:
    """A row per text with its score by the listed words, and rows of the other words.

    Such a row has ``n`` times a ``word`` that is not listed, between the
    classes lc and rc, or the one behind it, ``next``, instead of rc; lc is
    NULL behind another such word.  Their classes and counts are still to be
    found.
    """

    def rows(**columns) -> pa.RecordBatch:
        size = len(columns["doc_id"])
        full = [columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in _SCORED]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(full, _SCORED, strict=True)], schema=pa.schema(_SCORED))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trained.value
        own, none = t.classes, t.classes.size
        for part in parts:
            doc, h, words = part.column("doc_id"), part.column("h"), part.column("rare").flatten()
            whole, ends = _with_ends(part.column("ids"), own.end)
            known, others = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
            base, score = np.zeros(len(ends)), np.zeros(len(ends))
            used = 0
            for i in range(0, len(whole), MOST_IN_RUN):
                # A token more on both sides: what pairs with the first and the last.
                stop = min(i + MOST_IN_RUN, len(whole))
                before = whole[i - 1 : i] if i else [own.end]
                after = whole[stop : stop + 1] if stop < len(whole) else [own.end]
                at = np.concatenate([before, whole[i:stop], after])
                chain, listed = own.of(at), at >= 0
                text = np.searchsorted(ends, np.arange(i, stop))
                first, stop_text = text[0], text[-1] + 1
                here = listed[1:-1]
                step = np.where(here, t.emission[np.maximum(at[1:-1], 0)], 0.0)
                step += np.where(here & listed[:-2], t.transition[chain[:-2], chain[1:-1]], 0.0)
                single = np.where(here, t.base[np.maximum(at[1:-1], 0)], 0.0)
                for total, weights in ((known, here), (others, ~here), (base, single), (score, step)):
                    total[first:stop_text] += np.bincount(text - first, weights=weights).astype(total.dtype)
                place = np.flatnonzero(~here)
                if not len(place):
                    continue
                # A word's number among all that are not listed; also that of the one behind a run.
                some = words.slice(used, len(place) + (at[-1] < 0)).dictionary_encode()
                used += len(place)
                code = some.indices.to_numpy().astype(np.int64)
                number = np.cumsum(~here) - 1
                lc = np.where(listed[place], chain[place], none)
                follows = ~listed[place + 2]
                rc = np.where(follows, none + 1 + code[np.minimum(number[place] + 1, len(code) - 1)], chain[place + 2])
                width = none + 1 + len(some.dictionary)
                key = ((text[place] - first) * len(some.dictionary) + code[number[place]]) * (none + 1) + lc
                _, at_first, n = np.unique(key * width + rc, return_index=True, return_counts=True)  # below 2**58
                for j in range(0, len(n), 20_000):
                    one = at_first[j : j + 20_000]
                    owner = pa.array(text[place[one]])
                    yield rows(
                        doc_id=doc.take(owner),
                        h=h.take(owner),
                        n=n[j : j + 20_000],
                        word=some.dictionary.take(pa.array(code[number[place[one]]])),
                        next=some.dictionary.take(pa.array(rc[one] - none - 1, mask=~follows[one])),
                        lc=pa.array(lc[one].astype(np.int32), mask=lc[one] == none),
                        rc=pa.array(np.where(follows[one], 0, rc[one]).astype(np.int32), mask=follows[one]),
                    )
            ends_known = 0 if t.end_known else 1
            yield rows(
                doc_id=doc, h=h, n_tokens=known + others, n_known=known - ends_known,
                base=base - others * t.base_total, score=score, n_rare=others,
            )
        pa.default_memory_pool().release_unused()

    return texts.select("doc_id", "h", "ids", "rare").mapInArrow(run, _SCORED_DDL)


def score_texts(docs: DataFrame, model: ClassModel = ClassModel()) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row.

    Training texts are those not held out.  A NULL or empty text is its end
    alone; a NULL id is held out; repeated rows get the same scores and count
    repeatedly in training; without training texts all words are unknown and
    classes equally likely; an empty table gives no rows; other columns are
    not read.  Words of one frequency are listed in the order of their bytes,
    a word equally good in two classes stays where it is or takes the lower
    one.  A very long text is counted and scored in runs of 2^17 words that
    overlap by one.  The driver holds the listed words and their classes, two
    bounded matrices (seed symbols, classes) and sums.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("h"), text.alias("text"))
    in_training = ~held_out(F.col("doc_id"))
    counts = stored(word_counts(rows.filter(in_training), model), "words")
    ends = rows.select("doc_id").filter(in_training).count()

    listed = counts.orderBy(F.desc("n"), "word").limit(model.listed).toArrow()
    words, numbers = listed["word"].to_pylist(), np.array(listed["n"].to_numpy(), dtype=np.int64)
    order = sorted(range(len(words)), key=lambda i: (-numbers[i], words[i]))
    words, numbers = [words[i] for i in order], numbers[order]
    texts = stored(encoded_texts(rows, spark.sparkContext.broadcast(words)), "encoded")
    classes, bigrams, others = train(texts.filter(in_training), words, numbers, model)

    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    own = classes.label[:-1]
    class_sum = np.bincount(own, weights=numbers, minlength=classes.size)
    class_words = np.bincount(own, minlength=classes.size)
    for r in others.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_sum[r["cls"]] += r["n"]
        class_words[r["cls"]] += r["v"]
    smoothed = np.log10(class_sum + model.add * (class_words + 1))
    base_total = float(np.log10(tokens + model.add * (distinct + 1)))
    table = bigrams + model.add_class
    trained = Trained(
        classes,
        np.log10(table / table.sum(1, keepdims=True)),
        np.append(np.log10(numbers + model.add) - smoothed[own], 0.0),
        smoothed,
        np.log10(np.append(numbers, ends) + model.add) - base_total,
        base_total,
        ends > 0,
    )
    part = stored(score_listed(texts, spark.sparkContext.broadcast(trained)), "scores")
    return _with_rare(part, others, trained, tokens, model)


def _with_rare(part: DataFrame, others: DataFrame, trained: Trained, tokens: int, model: ClassModel) -> DataFrame:
    """Add what pairs with a word that is not listed are worth: its class and count are joined by the word."""
    spark, classes = part.sparkSession, trained.classes

    known = others.select("word", F.col("n").alias("seen"), "cls")
    size = classes.size

    def looked_up(rows: DataFrame) -> DataFrame:
        tail = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(classes.endings)) + classes.first_ending
        return rows.join(known, "word", "left").withColumn("cls", F.coalesce("cls", tail.cast("int")))

    table = pa.table({"pair": pa.array(np.arange(size**2)), "step": pa.array(trained.transition.ravel())})
    steps = F.broadcast(spark.createDataFrame(table))  # size squared rows

    def with_step(rows: DataFrame, into: str, left: str, right: str) -> DataFrame:
        """NULL where there is no class on one of the sides."""
        pair = (F.col(left).cast("bigint") * size + F.col(right)).alias("pair")
        return rows.withColumn("pair", pair).join(steps.withColumnRenamed("step", into), "pair", "left").drop("pair")

    words = part.filter(F.col("n").isNotNull()).select("doc_id", "h", "word", "next", "lc", "rc", "n")
    one = looked_up(words.drop("next"))
    one = with_step(with_step(one, "from_left", "lc", "cls"), "to_right", "cls", "rc")
    seen, n = F.coalesce("seen", F.lit(0)), F.col("n")
    count = F.log10(seen + model.add)
    total = F.element_at(F.array(*[F.lit(float(x)) for x in trained.smoothed]), F.col("cls") + 1)
    around = F.coalesce("from_left", F.lit(0.0)) + F.coalesce("to_right", F.lit(0.0))
    one = one.select(
        "doc_id", "h", (n * count).alias("base"), (n * (around + count - total)).alias("score"),
        F.when(seen > 0, n).otherwise(0).alias("known"), n.alias("k"),
    )
    two = looked_up(words.filter(F.col("next").isNotNull()).select("doc_id", "h", "word", "next", "n"))
    two = looked_up(two.select("doc_id", "h", F.col("cls").alias("lc"), F.col("next").alias("word"), "n"))
    two = with_step(two, "step", "lc", "cls").select(
        "doc_id", "h", F.lit(0.0).alias("base"), (n * F.col("step")).alias("score"),
        F.lit(0).cast("bigint").alias("known"), F.lit(0).cast("bigint").alias("k"),
    )
    sums = one.unionByName(two).groupBy("doc_id", "h").agg(
        F.sum("base").alias("add_base"), F.sum("score").alias("add"), F.sum("known").alias("known"), F.sum("k").alias("k")
    )
    key = F.struct("doc_id", "h").alias("key")  # never NULL
    per_text = sums.select(key, "add_base", "add", "known", "k")
    texts = part.filter(F.col("n_tokens").isNotNull()).select("doc_id", "n_tokens", "n_known", "base", "score", "n_rare", key)
    joined = texts.join(per_text, "key", "left")
    # Rows alike have been summed together: their part is the share of one.
    times = F.coalesce(F.col("k") / F.greatest("n_rare", F.lit(1)), F.lit(1.0))
    return joined.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce((F.col("known") / times).cast("bigint"), F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("add_base") / times, F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce(F.col("add") / times, F.lit(0.0))).alias("score"),
    )


def op10_class_lm(docs: DataFrame) -> DataFrame:
    """The contract's columns are those of ``score_texts``."""
    return score_texts(docs)
