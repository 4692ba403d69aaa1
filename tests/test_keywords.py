import random

import pytest

from inkveil.functions.rules import keyword_rules
from inkveil.operators.keywords import Keywords, detect_keywords, redact_keywords
from inkveil.operators.redact import redact
from inkveil.plans.scratch import Staging
from tests import plain

LETTERS = "abAB [].-_éİıſsSKk█redactedREDACTED"


def chained(text, words, style, **flags):
    return plain.redact(text, keyword_rules(words, **flags), style)


@pytest.mark.parametrize("seed", range(150))
def test_a_sweep_is_the_chain_of_its_rules(seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    words = [some(rng.choice([1, 1, 2, 3, 5])) for _ in range(rng.randint(1, 12))]
    words += rng.sample(["redacted", "[redacted]", "ACT", "]", "█", "██", "d]", " [", "e", "red"], 3)
    rng.shuffle(words)
    flags = {"case_sensitive": rng.random() < 0.3, "whole_word": rng.random() < 0.4}
    for style in ("box", "label"):
        table = Keywords(words, style, **flags)
        for text in (some(60), some(8), ""):
            assert table.redact(text) == chained(text, words, style, **flags), (words, flags, style, text)
            assert table.counts(text) == plain.detect(text, keyword_rules(words, **flags))


def table_of(spark, words):
    return spark.createDataFrame(list(enumerate(words)), "rule_no int, keyword string")


@pytest.mark.parametrize("style", ["box", "label"])
def test_hundreds_of_keywords_as_the_rule_chain(spark, sf_dir, style):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(120).cache()
    texts = [r["text"] or "" for r in docs.collect()]
    rng = random.Random(1)
    words = sorted({w[: rng.randint(2, 9)] for t in texts for w in rng.sample(t.split() or [""], min(4, len(t.split()) or 1))})[:300]
    rng.shuffle(words)
    keywords = table_of(spark, [*words, "", "  ", None, words[0], "redacted"])
    rules = keyword_rules([*words, words[0], "redacted"])
    want = {d: plain.redact(t or "", rules, style) for d, t in docs.collect()}
    for limit in (10**6, 400):  # one pass, and many
        got = redact_keywords(docs, keywords, style, table_chars=limit).collect()
        assert {r["doc_id"]: (r["redacted"], r["n_redacted"]) for r in got} == want
        found = detect_keywords(docs, keywords, table_chars=limit).collect()
        for r in found[:40]:
            assert {m["label"]: m["n"] for m in r["matches"]} == plain.detect(r["text"], rules)
    few = keyword_rules(words[:12])
    same = redact(docs, few, style).collect()
    assert {r["doc_id"]: r["redacted"] for r in same} == {
        r["doc_id"]: r["redacted"] for r in redact_keywords(docs, table_of(spark, words[:12]), style).collect()
    }


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a Token, tokens"), (3, "a Token, tokens")], "id int, text string")
    done = redact_keywords(docs, table_of(spark, ["token"]), "label", whole_word=True)
    assert done.columns == ["id", "text", "redacted", "n_redacted"]
    assert sorted(map(tuple, done.select("id", "redacted", "n_redacted").collect()), key=repr) == [
        (1, None, 0), (2, "", 0), (3, "a [REDACTED], tokens", 1), (3, "a [REDACTED], tokens", 1)
    ]
    nothing = redact_keywords(docs, table_of(spark, []))
    assert [r["redacted"] for r in nothing.orderBy("id").collect()] == [None, "", *["a Token, tokens"] * 2]
    assert [r["matches"] for r in detect_keywords(docs, table_of(spark, [])).collect()] == [[]] * 4


def test_time_does_not_follow_the_length_of_the_table():
    import time

    text = " ".join(f"word{i % 5000}" for i in range(20_000))
    times = []
    for n in (1_000, 30_000):
        table = Keywords([f"none{i}x" for i in range(n)])
        start = time.process_time()
        for _ in range(3):
            assert table.redact(text) == (text, 0)
        times.append(time.process_time() - start)
    assert times[1] < 5 * times[0] + 0.2


@pytest.mark.parametrize("style", ["box", "label"])
def test_whole_words_are_known_by_their_run(spark, style):
    words = ["then", "Then", "e1", "é", "k", "ſki", "the_n", "redacted"]
    table = Keywords(words, style, whole_word=True)
    assert len(table.automaton) == 0 and not hasattr(table, "rules")
    rules = keyword_rules(words, whole_word=True)
    for text in ("Then the_n e1 É k K", "ſKI ski-THEN e1e1 then", "", "redacted then", "a then_ then. THEN"):
        now, total, found = text, 0, {}
        for rule in rules:
            if n := len(rule.compiled().findall(text)):
                found[rule.label] = found.get(rule.label, 0) + n
            now, n = rule.compiled().subn("[REDACTED]" if style == "label" else (lambda m: "█" * len(m[0])), now)
            total += n
        assert table.redact(text) == (now, total) and table.counts(text) == found


def test_detection_by_a_long_table_has_one_part_at_a_time(spark, tmp_path):
    staging = Staging(spark)
    docs = spark.createDataFrame([(1, "aa bb cc aa"), (2, None)], "id int, text string")
    table = spark.createDataFrame([(i, w) for i, w in enumerate(["cc", "aa", "bb"])], "rule_no int, keyword string")
    found = detect_keywords(docs, table, table_chars=2, staging=staging)
    assert len(staging.paths) == 2
    got = {r.id: [(m.label, m.n) for m in r.matches] for r in found.collect()}
    assert got == {1: [('Keyword: "cc"', 1), ('Keyword: "aa"', 2), ('Keyword: "bb"', 1)], 2: []}
