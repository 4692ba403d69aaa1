"""The Arrow pass against Python's ``re``, and how work is dealt."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkveil.functions import arrow_pass
from inkveil.functions.dialect import to_re2
from inkveil.functions.rules import BOX_MARK, LABEL_MARK, PATTERNS, build_rules, detector_rules
from inkveil.operators.redact import redact
from inkveil.operators.spans import redaction_spans, spans_of
from inkveil.plans import workload

RULES = {
    "catalog": detector_rules(),
    "mixed": build_rules([*PATTERNS][:3], ["sk", "REDACTED", "i", "e 1"], ["[a-z]+n[.,]", "m.{3}", "(?:er|he)+n", r"[^\s-]{2}\b", "[ks]i"]),
    "cased": build_rules(["URLs"], ["Sk", "i"], [r"[A-K]\w\s"], case_sensitive=True, whole_word=True),
}
SCRAPS = [
    "a@b.co", "x@y", "555-010-1234", "4000 0000 0258 3696", "12-34-5678", "123-12-1234", "1/2/1999", "https://e.x/", "10.0.0.1", "X0008369612",
    "GB2900000000000083", "12345-6789", " ", "\n", "\x1c", "\x85", "\xa0", "_", "-", "then", "ſ", "K", "İ", "ı", "é", "٣٤٥", "█", "\x01", "\x02", "\x03", "[REDACTED]", "ski", "m123", "９",
]


def texts(n=400, seed=3):
    rand = random.Random(seed)
    plain = [s for s in SCRAPS if s.isascii() and s >= " "]
    made = ["".join(rand.choices(plain if i % 2 else SCRAPS, k=rand.randrange(12))) for i in range(n)]
    return [*made, None, "", None]


def by_python(text, rules, style):
    """Text, number of substitutions, and matches on the original by rule."""
    now, total = text, 0
    for rule in rules:
        now, n = re.compile(rule.pattern, rule.flags).subn(LABEL_MARK if style == "label" else (lambda m: BOX_MARK * len(m[0])), now)
        total += n
    return now, total, [sum(1 for _ in rule.compiled().finditer(text)) for rule in rules]


@pytest.mark.parametrize("style", ["box", "label"])
@pytest.mark.parametrize("kind", RULES)
def test_the_pass_gives_what_python_gives(kind, style, monkeypatch):
    monkeypatch.setattr(arrow_pass, "SLICE_BYTES", 300)
    chain, given = arrow_pass.arrow_chain(RULES[kind]), texts()
    done = [row for part in arrow_pass.slices(pa.array(given)) for row in arrow_pass._redacted(part, chain, style, True).to_pylist()]
    for text, row in zip(given, done, strict=True):
        if text is not None:
            assert (row["text"], row["n"], row["counts"]) == by_python(text, RULES[kind], style), text


@pytest.mark.parametrize("style", ["box", "label"])
@pytest.mark.parametrize("kind", RULES)
def test_the_pass_finds_the_spans_of_each_text(kind, style):
    chain, given = arrow_pass.arrow_chain(RULES[kind]), texts(seed=4)
    done = arrow_pass._spans(pa.array(given), chain, style, spans_of).to_pylist()
    assert done == [[s._asdict() for s in spans_of(t or "", chain.sources, style)] for t in given]


def test_ascii_texts_whose_boxes_stand_apart_are_not_handed_on():
    given = pa.array(["a@b.co (https://e.x/1) 12345", "nothing", ""] * 3)

    def none(*_):
        raise AssertionError

    found = arrow_pass._spans(given, arrow_pass.arrow_chain(detector_rules()), "box", none).to_pylist()
    assert [len(f) for f in found] == [3, 0, 0] * 3


def test_patterns_that_cannot_be_promised_are_left():
    assert [to_re2(p) for p in ("^a", "a$", "a*", "é", "(?=a)b", "(a*)+b", "a{1001}", "\x01")] == [None] * 8
    assert arrow_pass.arrow_chain(detector_rules(), "python") is None


def test_redact_is_one_arrow_pass(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "id int, text string")
    done = redact(docs, RULES["mixed"], "box", matches_into="m")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "RLIKE" not in plan
    for row in done.collect():
        if row.text is None:
            assert (row.redacted, row.n_redacted, row.m) == (None, 0, [])
        else:
            assert (row.redacted, row.n_redacted) == by_python(row.text, RULES["mixed"], "box")[:2]
    found = redaction_spans(docs, RULES["mixed"], "box").groupBy("id").agg(F.count("*").alias("n"))
    assert {r.id: r.n for r in found.collect()} == {r.id: r.n_redacted for r in done.collect() if r.n_redacted}


def test_batches_for_python_are_small(spark):
    redact(spark.createDataFrame([("a",)], "text string"), detector_rules())
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= 8 << 20


def test_orders_of_one_file_are_dealt(spark, tmp_path):
    columns = ["id AS o_orderkey", "id % 7 AS o_custkey", "date'2020-02-03' AS o_orderdate"]
    spark.range(400).selectExpr(*columns).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    made = workload.dense(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() >= 8
    assert made.select(F.spark_partition_id()).distinct().count() >= 8
    assert made.select("o_orderkey").distinct().count() == made.count() == 400


def test_documents_in_a_folder_of_files_are_streamed(spark, tmp_path):
    rows = [(i, f"mail a{i}@b.co", "en", "s", 9) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    named = workload.registered()["redact_stream_named"](spark, str(tmp_path)).collect()
    assert sorted(r.seq for r in named) == [*range(30)] and len({r.output for r in named}) == 30
    assert workload.registered()["redact_stream"](spark, str(tmp_path)).count() == 30
