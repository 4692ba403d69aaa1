import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.llm.class_lm import (
    ClassModel,
    best_classes,
    encoded_texts,
    ending,
    exchange,
    likelihood,
    op10_class_lm,
    score_texts,
    text_runs,
    train,
)
from inkveil.llm import class_lm
from inkveil.llm.common import words_of
from tests.llm.edge import empty, frame, rows

SMALL = ClassModel(seeds=30, classes=6, endings=8, listed=60, held_words=50)


def base(docs):
    """Expected columns in plain Python, by row."""
    train = Counter()
    for doc, text in docs:
        if zlib.crc32(("" if doc is None else str(doc)).encode()) % 10:
            train.update([*words_of(text), None])
    n, v = sum(train.values()), len(train)
    out = []
    for doc, text in docs:
        tokens = [*words_of(text), None]
        score = sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        held = zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0
        out.append((doc, held, len(tokens), sum(train[t] > 0 for t in tokens), n, score))
    return out


def languages(n=240):
    """Two languages whose words alternate between two halves: classes are worth much."""
    rng = np.random.default_rng(3)
    docs = []
    for i in range(n):
        vocab = [f"{'ab'[i % 2]}{k}{half}" for half in "xy" for k in range(40)]
        words = [vocab[40 * (j % 2) + int(40 * rng.random() ** 2)] for j in range(60)]
        docs.append((i, " ".join(words)))
    return docs


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


@pytest.mark.parametrize("model", [ClassModel(), SMALL])
def test_base_columns_and_held_out_gain(spark, model):
    docs = languages()
    got = score_texts(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), model).collect()
    same(got, base(docs))
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)


def test_next_words_have_probability_one_in_all(spark):
    """Scores of all one-word texts, weighted, sum to P(one word, end) <= 1, and differ by word."""
    docs = languages(60)
    words = sorted({w for _, t in docs for w in t.split()})
    probes = [(10**6 + i, w) for i, w in enumerate(words)]
    held = [(d, w) for d, w in probes if zlib.crc32(str(d).encode()) % 10 == 0]
    got = score_texts(spark.createDataFrame(docs + held, "doc_id bigint, text string"), SMALL).collect()
    total = sum(10 ** r["score"] for r in got if r["doc_id"] >= 10**6)
    assert 0 < total < 1


def test_exchange_finds_classes_and_never_loses():
    rng = np.random.default_rng(1)
    n, truth = 24, np.arange(24) % 4
    table = np.zeros((n + 1, n + 1))
    for a in range(n):
        for b in range(n):
            if truth[b] == (truth[a] + 1) % 4:
                table[a, b] = rng.integers(5, 30)
    shuffled = rng.permutation(n)
    table[:n, :n] = table[np.ix_(shuffled, shuffled)]

    def gain(label):
        m = np.zeros((n + 1, label.max() + 1))
        m[np.arange(n + 1), label] = 1
        t = m.T @ table @ m

        def f(x):
            return (x * np.log(np.maximum(x, 1e-300))).sum()

        return f(t) - f(t.sum(0)) - f(t.sum(1))

    label = exchange(table, n, 4, 10)
    start = np.concatenate([np.arange(n) % 4, [4]])
    assert gain(label) >= gain(start) and label[n] == 4
    best = gain(np.concatenate([truth[shuffled], [4]]))
    assert gain(label) >= 0.5 * best if best > 0 else gain(label) >= 2 * best


def test_edges(spark):
    got = op10_class_lm(frame(spark)).collect()
    same(got, base([(r[0], r[1]) for r in rows()]))
    assert all(r["score"] < 0 for r in got)
    assert op10_class_lm(empty(spark)).count() == 0
    nobody = [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = op10_class_lm(spark.createDataFrame(nobody, "doc_id bigint, text string")).collect()
    assert len(got) == len(nobody) and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)


def mixed_texts():
    """Frequent and rare words, words seen only when held out, runs of them, repeated rows."""
    rng = np.random.default_rng(8)
    docs = languages(120)
    for i in range(120, 300):
        words = [f"r{int(400 * rng.random() ** 3)}" for _ in range(int(rng.integers(0, 30)))]
        docs.append((i, " ".join(words + [f"only{i}"] * (i % 4))))
    return docs + [docs[140], docs[141], docs[-1], docs[-1], (None, "r1 none none"), (301, None)]


def test_score_recomputed_from_texts(spark, monkeypatch):
    """Classes as trained; transitions, emissions and scores again in plain Python, with short runs."""
    monkeypatch.setattr(class_lm, "MOST_IN_RUN", 7)
    docs = mixed_texts()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = score_texts(frame, SMALL).collect()
    same(got, base(docs))

    training = [words_of(t) for d, t in docs if d is not None and zlib.crc32(str(d).encode()) % 10]
    count = Counter(w for words in training for w in words)
    listed = sorted(count, key=lambda w: (-count[w], w))[: SMALL.listed]
    texts = frame.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0)
    texts = encoded_texts(texts.withColumn("h", F.lit(0).cast("bigint")), spark.sparkContext.broadcast(listed))
    classes, table, others = train(texts, listed, np.array([count[w] for w in listed]), SMALL)
    cls = dict(zip(listed, classes.label.tolist()))
    rest = others.select("word", "n", "cls").collect()
    assert {bytes(r["word"]): r["n"] for r in rest} == {w: n for w, n in count.items() if w not in cls}
    far = {bytes(r["word"]): r["cls"] for r in rest}
    end, size = classes.size - 1, classes.size

    def at_end(w):
        return classes.first_ending + ending(w, SMALL.endings)

    want = np.zeros((size, size))
    for words in training:
        for left, right in zip([None, *words], [*words, None]):
            b = end if right is None else cls.get(right, far.get(right))
            if left is None or left in cls:
                a = end if left is None else cls[left]
            else:
                a = at_end(left) if right in far else far[left]
            want[a, b] += 1
    assert (want == table).all()

    p = np.log10((want + SMALL.add_class) / (want + SMALL.add_class).sum(1, keepdims=True))
    all_cls = {**cls, **far}
    mass, kinds = Counter(), Counter(all_cls.values())
    for w, c in all_cls.items():
        mass[c] += count[w]

    def score(text):
        total, a = 0.0, end
        for w in words_of(text):
            b = all_cls.get(w, at_end(w))
            total += p[a, b] + math.log10((count[w] + SMALL.add) / (mass[b] + SMALL.add * (kinds[b] + 1)))
            a = b
        return total + p[a, end]

    by_id = {}
    for d, t in docs:
        by_id.setdefault(d, score(t))
    assert len(got) == len(docs)
    for r in got:
        assert r["score"] == pytest.approx(by_id[r["doc_id"]], rel=1e-9)


def test_best_class_is_that_of_highest_likelihood():
    rng = np.random.default_rng(5)
    size, words = 7, 30
    label = rng.integers(0, size - 1, words)
    pairs = rng.integers(0, 4, (words + 1, words + 1)) * (rng.random((words + 1, words + 1)) < 0.3)
    np.fill_diagonal(pairs, 0)
    of = np.append(label, size - 1)

    def table(of):
        m = np.zeros((words + 1, size))
        m[np.arange(words + 1), of] = 1
        return m.T @ pairs @ m

    for w in range(words):
        left, right = np.zeros(size), np.zeros(size)
        np.add.at(left, of, pairs[:, w])
        np.add.at(right, of, pairs[w])
        cells = np.concatenate([left, right])
        ctx = np.flatnonzero(cells)
        if len(ctx) == 0:
            continue
        got = best_classes(table(of), of[[w]], ctx, cells[ctx], np.array([0]))[0]
        values = []
        for b in range(size - 1):
            moved = of.copy()
            moved[w] = b
            values.append(likelihood(table(moved)))
        assert values[got] == pytest.approx(max(values), rel=1e-9)


def test_runs_of_a_long_text():
    ids = np.array([3, -1, 2, -1, -1, 0, 1], dtype="<i4")
    for most in (1, 2, 3, 7, 8):
        class_lm_most, class_lm.MOST_IN_RUN = class_lm.MOST_IN_RUN, most
        try:
            runs = list(text_runs(ids.tobytes(), [b"x", b"y", b"z"], 9))
        finally:
            class_lm.MOST_IN_RUN = class_lm_most
        assert np.concatenate([a for a, _ in runs]).tolist() == [*ids.tolist(), 9]
        assert [w for _, ws in runs for w in ws] == [b"x", b"y", b"z"]


def test_words_beyond_the_seeds_are_clustered(spark):
    """Every word but the seeds is rare alone; their classes are learned all the same."""
    rng = np.random.default_rng(2)
    docs = [
        (i, " ".join(f"{'xy'[j % 2]}{int(300 * rng.random())}{'ab'[int(rng.random() * 2)]}" for j in range(40)))
        for i in range(400)
    ]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = ClassModel(seeds=20, classes=4, endings=4, listed=100)
    for m in (model, ClassModel(seeds=20, classes=4, endings=4, listed=5000)):
        held = [r for r in score_texts(frame, m).collect() if r["held_out"]]
        gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
        assert gain > 0.15  # endings say nothing; half of the most possible, log10(2)


def test_packed_cells_and_sums():
    size = 5
    keys = np.array([1, 3, 12, 19, 40])
    n = np.array([1, 65_535, 65_536, 200_000, 7])
    schema = class_lm.pa.schema([("at", class_lm.pa.int32()), ("cells", class_lm.pa.binary())])
    part = class_lm._packed(keys, n, size, schema)
    got = Counter()
    for at, cells in zip(*(c.to_pylist() for c in part.columns), strict=True):
        for ctx, k in np.frombuffer(cells, dtype=class_lm._CELL).tolist():
            got[at * 2 * size + ctx] += k
    assert part.column(0).to_pylist() == [0, 1, 4] and got == dict(zip(keys.tolist(), n.tolist()))
    values, sums = class_lm._summed([keys, keys[:2]], [n, n[:2]])
    assert values.tolist() == keys.tolist() and sums.tolist() == [2, 131_070, *n[2:].tolist()]


def test_words_and_endings_of_a_batch_are_those_of_each_text():
    texts = ["", "  ", "a", " B\x0bc\x0c\td ", "É\x1cx\x85  y z  ẞ", "\n\n", "x" * 9 + " é"]
    counts, words = class_lm._words(class_lm.pa.array(texts).slice(1))
    assert counts.tolist() == [len(words_of(t)) for t in texts[1:]]
    assert words.to_pylist() == [w for t in texts[1:] for w in words_of(t)]
    tails = class_lm._tail_endings(7)[class_lm._tails(words)]
    assert tails.tolist() == [ending(w, 7) for w in words.to_pylist()]


def test_counts_of_classes_read_numbers_alone(spark):
    """Passes over the training texts that need no other words do not read them."""
    listed = [b"a", b"b"]
    docs = spark.createDataFrame([(1, 0, "a b xy a"), (2, 0, "zq b")], "doc_id bigint, h bigint, text string")
    texts = encoded_texts(docs, spark.sparkContext.broadcast(listed))
    classes = class_lm.Classes(np.array([0, 1, 2 + 4]), 2, 4)
    tables = class_lm.class_tables(texts.drop("rare"), spark.sparkContext.broadcast(classes), classes.size)
    want = np.zeros((2, 7, 7))
    for words in ([b"a", b"b", b"xy", b"a"], [b"zq", b"b"]):
        seen = [(listed.index(w), True) if w in listed else (2 + ending(w, 4), False) for w in words]
        for (x, i), (y, j) in zip([(6, True), *seen], [*seen, (6, True)]):
            want[0, x, y] += 1
            want[1, x, y] += i and j
    assert (tables == want).all()


def test_gains_worked_out_once_choose_alike(monkeypatch):
    rng = np.random.default_rng(4)
    size = 6
    table = rng.integers(50, 400, (size, size)).astype(float)
    ctx = np.concatenate([np.sort(rng.choice(2 * size, 5, replace=False)) for _ in range(200)])
    n, starts = rng.integers(1, 60, len(ctx)).astype(float), np.arange(200) * 5
    for own in (np.full(200, -1), rng.integers(0, size - 1, 200)):
        got = best_classes(table, own, ctx, n, starts, class_lm.Gains(table))
        monkeypatch.setattr(class_lm.Gains, "most", 0)  # all counts beyond those worked out
        assert (got == best_classes(table, own, ctx, n, starts)).all()
        monkeypatch.undo()


def test_cells_of_a_word_over_many_batches(monkeypatch):
    """A word that goes on over batches is kept as sums, the last one comes out whole."""
    monkeypatch.setattr(class_lm, "MOST_HELD", 3)
    words = [b"a"] * 7 + [b"b"] + [b"c"] * 4
    rows = [(w, i % 2, 4 + i % 3) for i, w in enumerate(words)]
    parts = [
        class_lm.pa.RecordBatch.from_arrays(
            [class_lm.pa.array([r[0] for r in some], class_lm.pa.binary()), *(class_lm.pa.array([r[c] for r in some], class_lm.pa.int32()) for c in (1, 2))],
            names=["word", "l", "r"],
        )
        for some in (rows[:2], rows[2:5], rows[5:9], rows[9:])
    ]
    got, seen = Counter(), []
    for found, keys, sums in class_lm._rare_sums(iter(parts), 10):
        seen += found.to_pylist()
        for k, n in zip(keys.tolist(), sums.tolist(), strict=True):
            got[found[k // 10].as_py(), k % 10] += n
    assert seen == [b"a", b"b", b"c"]
    assert got == Counter((w, c) for w, l, r in rows for c in (l, r))
