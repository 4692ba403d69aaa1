import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkveil.llm.packing import PackingRules, best_cuts, op9_packing, pack_documents, sentence_ends, token_ids, tokenizer
from tests.llm.edge import empty, frame, prose


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def test_ids_are_those_of_the_library(spark, sf_dir, library):
    own = tokenizer(PackingRules().ranks)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["", "  \n\n\t x", "漢字 🎈🎈 ß́", "<|endoftext|> a", "a" * 3000, "1234567 1,000.5", "don't WE'LL\r\n", " 　x", "\x00\x01"]
    for text in texts:
        assert own.encode_ordinary(text) == library.encode(text, add_special_tokens=False).ids


def test_sentence_ends():
    own = tokenizer(PackingRules().ranks)
    ends = sentence_ends(PackingRules().ranks, 0)
    ids = own.encode_ordinary("One two. Three four!\n")
    assert [bool(x) for x in ends[ids]].count(True) >= 2 and not ends[own.encode_ordinary(" two")[0]] and ends[0]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_optimal(seed):
    rng = random.Random(seed)
    places, at = [], 0
    for _ in range(rng.randint(1, 40)):
        at += rng.randint(1, 12)
        places.append(at)
    pen = [rng.choice([0, 3, 7]) for _ in places]
    length = 20

    def cost(cuts):
        total, last = 0, 0
        for c in cuts:
            assert c - last <= length
            total += length - (c - last) + pen[places.index(c)]
            last = c
        return total

    best = {0: 0}
    for p, extra in zip(places, pen):
        best[p] = min(v + length - (p - q) for q, v in best.items() if p - q <= length) + extra
    got = best_cuts(np.array(places), np.array(pen), length)
    assert got[-1] == places[-1] and cost(got) == best[places[-1]]


def check(rows, docs, library, length=1024):
    """Pieces tile every document, have its ids, and lie gapless in sequences."""
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for _, t in docs]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    want = {}
    for (doc, _), own in zip(docs, ids, strict=True):
        want.setdefault(doc, []).append(own)
    assert set(by_doc) == set(want)
    for doc, found in by_doc.items():
        assert sum(r["length"] for r in found) == sum(map(len, want[doc]))
        for r in found:
            match = [
                x for x in want[doc]
                if len(x) == r["doc_tokens"]
                and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) == r["ids_crc32"]
            ]
            assert match
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return len(by_sequence), sum(map(len, ids))


def test_round_trip_and_little_padding(spark, library):
    docs = [(i, prose(i, 20 + 7 * (i % 90))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    rows = pack_documents(df, tokens=True).collect()
    n, tokens = check(rows, docs, library)
    assert 1 - tokens / (1024 * n) < 0.08
    for r in rows[:50]:
        assert zlib.crc32(np.array(r["tokens"], dtype="<u4").tobytes()) == r["ids_crc32"]
    # Sequences follow the documents' order.
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))]
    assert order == sorted(order)
    small = pack_documents(df, rules=PackingRules(length=256, grid=32, stretch=5000)).collect()
    check(small, docs, library, 256)


def test_edges(spark, library):
    docs = frame(spark)
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(op9_packing(docs).collect(), pairs, library)
    assert op9_packing(empty(spark)).count() == 0


def test_added_tokens_are_those_of_the_library_by_default(spark):
    plain, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokenizer(PackingRules().ranks)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext|", "  <|endoftext|>  \n", "no marks. At all"]
    for text in texts:
        assert token_ids(own, text) == plain.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pack_documents(docs, tokens=True).collect():
        ids = [*plain.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert (r["start"], r["length"], r["doc_tokens"]) == (0, len(ids), len(ids))
        assert r["tokens"] == ids


def test_texts_of_many_megabytes_have_the_ids_of_the_library():
    plain, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokenizer(PackingRules().ranks)
    line = " ".join(prose(8, 600).split())
    for text in (
        " " * 1_200_000, "\n" * 1_100_000 + "end", "a" + "\t" * 1_000_000 + " b", "x" * 400_000, (line + "\n") * 200,
        " " * 50_000 + "<|endoftext|>" + "\n" * 60_000 + " z<|endoftext|>",
    ):
        assert token_ids(own, text) == plain.encode(text, add_special_tokens=False).ids
