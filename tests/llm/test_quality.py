import math
import re
from collections import Counter

from pyspark.sql import functions as F

from inkveil.llm.quality import (
    Risk,
    Rule,
    certified_cutoffs,
    default_rules,
    judge,
    keep_good,
    op7_quality,
    with_statistics,
)
from tests.llm.edge import empty, frame, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines), len(lines) - len(set(lines)), len(covered),
    )


def test_statistics_match_plain_python(spark):
    texts = [prose(i, 60, vocabulary=4) for i in range(20)] + [prose(i, 90) for i in range(10)]
    texts += ["a b c d e f g h a b c d e f g h", "x " * 500, "#a $b\n#a $b\n\n\n", "é 漢 🎈|", "a b c d e f g", None, ""]
    texts += [prose(5, 30) + " " + prose(5, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: tuple(r)[1:] for r in with_statistics(df).drop("text").collect()}
    for i, text in enumerate(texts):
        assert got[i] == statistics(text), text


def at_most(n, x, p):
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))


def test_cutoffs_are_the_lowest_that_pass_the_exact_test(spark):
    rules = [Rule("a", F.col("a"), [0.1, 0.2, 0.5]), Rule("b", F.col("b"), [1.0, 2.0])]
    risk = Risk(alpha=0.1, delta=0.05)
    rows = [("x", i / 200, 1.5 * (i % 15 == 0)) for i in range(200)]
    rows += [(None, 0.0, 3.0 * (i % 40 == 0)) for i in range(150)] + [("few", 0.0, 0.0)] * 5
    df = spark.createDataFrame(rows, "s string, a double, b double")
    got = {r["stratum"]: r["cutoffs"] for r in certified_cutoffs(df, "s", rules, risk).collect()}
    want = {}
    for stratum in ("x", None, "few"):
        own = [r[1:] for r in rows if r[0] == stratum]
        for i, rule in enumerate(rules):
            for cutoff in sorted(rule.cutoffs, reverse=True):
                x = sum(r[i] > cutoff for r in own)
                if x < 0.1 * len(own) and at_most(len(own), x, 0.1) <= 0.05 / (3 * 5):
                    want.setdefault(stratum, {})[rule.name] = cutoff
    assert got == want and "few" not in got


def labelled(spark):
    good = [(i, prose(i, 60), "en") for i in range(2500)]
    bad = [(10000 + i, " | ".join(prose(i, 40).split()), "en") for i in range(200)]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string")
    labels = [(i, 1, 0) for i in range(2300)] + [(10000 + i, 0, 0) for i in range(100)]
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality bigint, toxic bigint")


def test_bad_documents_go_and_good_ones_stay(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r["kept"] for r in op7_quality(docs, labels).collect()}
    good, bad = [v for k, v in got.items() if k < 10000], [v for k, v in got.items() if k >= 10000]
    assert len(got) == 2700 and sum(good) >= 0.97 * len(good) and not any(bad)
    left = keep_good(docs, labels)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {k for k, v in got.items() if v}


def test_base_rule_without_labels(spark):
    docs, labels = labelled(spark)
    rows = op7_quality(docs.limit(50), labels.limit(0)).collect()
    assert len(rows) == 50 and all(r["kept"] == (not r["base_failed"]) for r in rows)


def test_edges(spark):
    docs, (_, labels) = frame(spark), labelled(spark)
    strange = labels.limit(5).unionByName(spark.createDataFrame([(None, None, None), (5, None, 1)], labels.schema))
    got = judge(docs, strange)
    assert got.count() == docs.count()
    want = Counter((r["doc_id"], *statistics(r["text"])) for r in docs.collect())
    stats = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    assert Counter((r["doc_id"], *[r[c] for c in stats]) for r in got.collect()) == want
    assert keep_good(docs, strange).columns == docs.columns
    assert op7_quality(empty(spark), labels).count() == 0 and keep_good(empty(spark), labels.limit(0)).count() == 0
    assert len(default_rules()) == 5
