from collections import Counter, defaultdict

import numpy as np
import pytest

from inkveil.llm.common import words_of
from inkveil.llm.mixing import MixRules, mix, mix_documents, op2_mixing, passages, permute, target_words
from tests.llm.edge import empty, frame, prose

RULES = MixRules(block=32)


def test_targets():
    assert target_words([100, 100, 100], [1, 2, 3], 3) == [50, 100, 150]
    got = target_words([10, 100, 1000], [1, 2, 3], 3)
    assert got[0] == 30 and got[1] == 300 and got[2] == pytest.approx(780)
    assert sum(got) == pytest.approx(1110)
    assert target_words([], [], 3) == [] and target_words([0, 5], [1, 2], 3) == [0, 5]


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000])
def test_permutations(size):
    for key in (0, 1, 2**40):
        got = permute(np.arange(size), np.full(size, size), np.full(size, key))
        assert sorted(got) == list(range(size))
    assert size < 17 or list(got) != list(range(size))


def documents(spark):
    rows = [(i, prose(i, 40 + i % 90), "abc"[i % 7 % 3] if i % 11 else None) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)


def test_mix_comes_near_targets_and_keeps_bounds(spark):
    docs = documents(spark)
    placed, pieces, slots = mix(docs, rules=RULES)
    texts = {r["doc_id"]: len(words_of(r["text"])) for r in docs.collect()}
    target, source, size = {}, {}, {}
    for r in placed.collect():
        target[r["src"]], source[r["__doc"]], size[r["__doc"]] = r["__target"], r["src"], r["__size"]
    assert size == texts
    parts, taken = defaultdict(list), Counter()
    for r in pieces.collect():
        parts[r["__doc"]].append((r["begin"], r["words"]))
        taken[r["__doc"]] += r["uses"] * r["words"]
        assert r["words"] <= RULES.block and r["uses"] <= 3
    for doc, found in parts.items():  # the pieces tile the document
        at = 0
        for begin, n in sorted(found):
            assert begin == at
            at += n
        assert at == size[doc]
    per = Counter()
    for doc, n in taken.items():
        per[source[doc]] += n
        assert n <= 3 * size[doc]
    for src, want in target.items():
        assert per[src] == pytest.approx(want, rel=0.03)
    used = Counter((r["src"], r["pass"], r["block"]) for r in slots.collect())
    assert max(used.values()) == 1  # a permutation per pass
    places = [(r["shard"], r["slot"]) for r in slots.collect()]
    assert len(set(places)) == len(places)


def test_mixed_documents_have_the_words_taken(spark):
    docs = documents(spark)
    want = {r["doc_id"]: r["taken"] for r in op2_mixing(docs).collect()}
    again = {r["doc_id"]: r["taken"] for r in op2_mixing(docs.repartition(9)).collect()}
    assert want == again
    got = Counter()
    for r in mix_documents(docs).collect():
        got[r["doc_id"]] += len(words_of(r["text"]))
    assert got == Counter({k: v for k, v in want.items() if v})


def test_passages():
    text = "a  b c\nd e"
    assert passages(text, [(0, 2, 1), (2, 3, 3)]) == [text, "c\nd e", "c\nd e"]
    assert passages(text, [(0, 2, 1), (2, 2, 0), (4, 1, 1)]) == ["a  b\ne"]


def test_edges(spark):
    docs = frame(spark)
    rows = op2_mixing(docs).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(r["size"] for r in rows) == sorted(len(words_of(r["text"])) for r in docs.collect())
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words_of(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in rows)
    assert op2_mixing(empty(spark)).count() == 0 and mix_documents(empty(spark)).count() == 0


def test_clashing_columns_travel_along(spark):
    names = ["__key", "__pieces", "__source", "__copy", "__taken", "row", "__number"]
    own = ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame([(i, prose(i, 300), f"s{i % 2}", *[i] * len(names)) for i in range(20)], f"doc_id bigint, text string, source string, {own}")
    done = mix_documents(docs).collect()
    assert done and all(set(r[3:]) == {r["doc_id"]} for r in done)
