import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import regex

from inkveil.llm.byte_bpe import (
    BpeRules,
    decode_documents,
    encode_documents,
    encode_text,
    encoding_of,
    op12_byte_bpe,
    pieces,
)
from tests.llm.edge import empty, frame, prose

RULES = BpeRules()
PATTERN = regex.compile(public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def brute(text, ranks):
    """The definition: in each match the adjacent pair of least rank is merged, leftmost first."""
    out = []
    for match in PATTERN.finditer(text):
        parts = [bytes([b]) for b in match.group().encode()]
        while len(parts) > 1:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[p] for p in parts]
    return out


AWKWARD = [
    "", " ", "  a", "a  ", "don't WE'LL 'tis''s o'", "1234567 1,000.5", "漢字 🎈🎈 ß́ é", "a\r\n\r\n  b\t c",
    "\x00\x1c \x1d\x85 x\xa0 y　", "<|endoftext|> a", "x!y?z(1)2[a]'b", "́a", "١٢٣ abc½", "a" * 300,
]


def test_ids_follow_the_definition(ranks):
    own = encoding_of(RULES.ranks)
    for text in [*AWKWARD, prose(5, 60)]:
        assert encode_text(own, text).tolist() == brute(text, ranks)


def mixed(seed, n=400):
    rng = random.Random(seed)
    letters = "aZé漢 \t\n\r09٣.,!'s(\x85\xa0\u2003\u3000\x00\x1c🎈\u0301_-~`{[@"
    return "".join(rng.choice(letters) * rng.choice([1, 1, 1, 2, 9]) for _ in range(n))


@pytest.mark.parametrize("seed", range(40))
def test_cut_texts_have_the_ids_of_the_whole(seed):
    own, text = encoding_of(RULES.ranks), mixed(seed)
    want = own.encode_ordinary(text)
    for piece, blanks in ((1, 2), (3, 4), (10, 3), (50, 8), (5, 1000)):
        rules = BpeRules(piece=piece, blanks=blanks)
        assert "".join(p for p, _ in pieces(text, rules)) == text
        assert encode_text(own, text, rules).tolist() == want


def test_texts_of_many_megabytes():
    own = encoding_of(RULES.ranks)
    for text in (" " * 3_000_000, "\n" * 2_000_000 + "end", "a" + "\t" * 1_500_000 + " b", "word" * 500_000, "漢" * 700_000):
        ids = encode_text(own, text)
        assert own.decode_bytes(ids.tolist()).decode() == text
    line = " ".join(prose(3, 500).split()) + " "
    text = line * (3_000_000 // len(line))
    assert encode_text(own, text).tolist() == own.encode_ordinary(text)
    assert max(len(p) for p, _ in pieces(text)) < RULES.piece + 100
    # A long run of blanks is read as the pattern would read a short one.
    short, long = encode_text(own, "a" + " " * 50 + "b"), encode_text(own, "a" + " " * 2_000_000 + "b")
    assert (short[0], *short[-1:]) == (long[0], *long[-1:])


def test_multilingual_ranks(spark):
    rules = BpeRules(ranks="byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame([(1, "漢字 Straße")], "doc_id bigint, text string")
    row = decode_documents(encode_documents(docs, rules=rules), rules=rules).first()
    assert row["decoded"].decode() == "漢字 Straße"
    assert encoding_of(rules.ranks).encode_ordinary("漢字 Straße") == list(struct.unpack(f"<{len(row['ids']) // 4}I", row["ids"]))


def check(docs):
    own = encoding_of(RULES.ranks)
    want = []
    for r in docs.select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        ids = own.encode_ordinary(r["text"] or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want.append((r["doc_id"], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(raw).hexdigest()))
    got = op12_byte_bpe(docs)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_query(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_edges(spark):
    check(frame(spark))
    assert op12_byte_bpe(empty(spark)).count() == 0
    docs = frame(spark).withColumnRenamed("key", "ids").withColumnRenamed("node", "decoded")
    assert set(encode_documents(docs).columns) == set(docs.columns)
    awkward = spark.createDataFrame(list(enumerate([*AWKWARD, None, " " * 1_200_000])), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in decode_documents(encode_documents(awkward)).collect()}
    for i, text in enumerate([*AWKWARD, "", " " * 1_200_000]):
        assert bytes(rows[i]["decoded"]).decode() == text
