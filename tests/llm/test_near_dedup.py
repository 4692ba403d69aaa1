import random

import numpy as np
import pytest

from inkveil.llm.components import components
from inkveil.llm.near_dedup import (
    NearRules,
    _unequal_codes,
    estimate,
    near_duplicates,
    one_of_each,
    op1_near_dedup,
    shingle_set,
    signature,
    words_of,
)
from tests.llm.edge import empty, frame, prose


def shingles(text, k):
    words = words_of(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(docs, k, percent):
    """Least id reachable over links of all pairs; rows without an id have none."""
    sets = [(doc, shingles(text, k)) for doc, text in docs]
    up = {doc: doc for doc, _ in docs if doc is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            common = len(x & y)
            if a is not None and b is not None and x and y and 100 * common >= percent * len(x | y):
                low, high = sorted((top(a), top(b)))
                up[high] = low
    return {doc: top(doc) for doc in up}, [len(s) for _, s in sets]


def edited(words, rng, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return words


def corpus():
    """Groups of near copies of several shapes: stars, chains and exact copies."""
    rng = random.Random(4)
    docs = []
    for group in range(12):
        base = prose(100 + group, 150).split()
        for copy in range(rng.randint(2, 12)):
            words = edited(base, rng, rng.choice([0, 1, 2, 3, 5]))
            docs.append(" ".join(words))
            if group % 3 == 0:
                base = words  # a chain
    docs += [prose(1000 + i, 80) for i in range(40)]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("k,percent,chunk", [(3, 85, 1024), (5, 80, 1024), (3, 85, 3)])
def test_components_match_all_pairs(spark, k, percent, chunk):
    docs = corpus()
    rules = NearRules(shingle=k, percent=percent, chunk=chunk, broadcast_rows=0 if chunk == 3 else 10**6)
    found = near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), rules=rules).collect()
    want, sizes = brute(docs, k, percent)
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert {r["doc_id"]: r["n_shingles"] for r in found} == dict(enumerate(sizes))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_edges(spark):
    docs = frame(spark)
    found = op1_near_dedup(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    by = {}
    for r in found.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[5]) == 2 and {r["component_id"] for r in by[5] + by[6] + by[7]} == {5}
    assert [(r["component_id"], r["kept"]) for r in by[None]] == [(None, True)] * 2
    assert all(by[i][0]["n_shingles"] == 0 and by[i][0]["kept"] for i in (1, 2, 10))
    assert by[3][0]["n_shingles"] == 1
    assert op1_near_dedup(empty(spark)).count() == 0


def test_one_of_each_keeps_columns_and_one_row(spark):
    docs = frame(spark)
    left = one_of_each(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert ids.count(5) == 1 and ids.count(None) == 2 and not {6, 7} & set(ids)
    assert one_of_each(empty(spark)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200, 260)]
    star = [(1000, i) for i in range(1, 50)]
    links = spark.createDataFrame([*path, *star, (7, 7)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert {found[i] for i in range(200, 261)} == {200}
    assert {found[i] for i in (*range(1, 50), 1000)} == {1}
    assert components(links.limit(0)).count() == 0


def test_shingle_hashes_do_not_depend_on_place():
    words = prose(9, 3000).encode().split()
    whole = shingle_set(words, 3)
    parts = [shingle_set(words[i : i + 3], 3) for i in range(len(words) - 2)]
    assert set(whole.tolist()) == {int(p[0]) for p in parts}
    assert len(whole) == len({tuple(words[i : i + 3]) for i in range(len(words) - 2)})


def test_estimate_is_unbiased():
    rules = NearRules(percent=85)
    rng, errors = np.random.default_rng(1), []
    for _ in range(60):
        a = rng.integers(0, 2**63, 300).astype(np.uint64)
        b = np.concatenate([a[:280], rng.integers(0, 2**63, 20).astype(np.uint64)])
        codes = [np.array([signature(np.unique(x), rules)[1]]) for x in (a, b)]
        (unequal,) = _unequal_codes(codes[0], codes[1][0], rules)
        errors.append(estimate(unequal, rules) - 280 / 320)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_star_whose_rays_are_no_links(spark):
    """Rays are near the middle alone: whichever leads a bucket, all must come together."""
    rng = random.Random(8)
    base = prose(50, 200).split()
    rays = [" ".join(edited(base, rng, 4)) for _ in range(40)]
    docs = [(i, t) for i, t in enumerate(rays)] + [(10**6, " ".join(base))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want, _ = brute(docs, 3, 85)
    for chunk, shingles in ((1024, 1 << 20), (4, 1 << 20), (1024, 900)):
        rules = NearRules(shingle=3, percent=85, chunk=chunk, chunk_shingles=shingles)
        got = near_duplicates(df, rules=rules).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_one_of_each_loses_no_text_and_compares_rows_without_an_id(spark):
    a, b, c = (" ".join(prose(i, 60).split()) for i in (31, 32, 33))
    rows = [(1, a, 1), (1, b, 2), (None, c, 3), (None, c + " end", 4), (None, a, 5), (2, b, 6), (2, b, 7), (None, "", 8), (None, "", 9), (3, None, 10)]
    names = ["key", "row", "id", "place", "best", "component", "__id", "__place"]
    own = ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame([(d, t, *[n] * len(names)) for d, t, n in rows], f"doc_id bigint, text string, {own}")
    left = [tuple(r) for r in one_of_each(docs).collect()]
    assert all(len(set(r[2:])) == 1 for r in left)
    kept = {r[2] for r in left}
    assert {1, 2, 10} <= kept and len(kept & {3, 4}) == 1 and len(kept & {8, 9}) == 1 and not kept & {5, 6, 7}
