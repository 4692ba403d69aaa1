import random

import pytest

from inkveil.functions.rules import build_rules, detector_rules
from inkveil.operators.redact import redact
from inkveil.operators.spans import partial_leaks, redaction_spans, spans_of
from tests import plain


def replayed(text, spans, style):
    """The substitutions done again, rule by rule."""
    for no in sorted({s.rule_no for s in spans}):
        for s in reversed([s for s in spans if s.rule_no == no]):
            mark = "[REDACTED]" if style == "label" else "█" * (s.size or 1)
            text = text[: s.at] + mark + text[s.at + s.size :]
    return text


@pytest.mark.parametrize("seed", range(120))
def test_replaying_the_spans_is_the_redaction(seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("ab1 []REDACTEDx█é🎈") for _ in range(n))
    rules = build_rules([], [some(rng.randint(1, 3)) or "a" for _ in range(5)], [r"\d+", r"a.b", r"T?E*", r"\]\s*\["][: rng.randint(0, 4)])
    rng.shuffle(rules)
    sources = [(r.pattern, r.flags) for r in rules]
    for style in ("box", "label"):
        text = some(50)
        spans = spans_of(text, sources, style)
        assert (replayed(text, spans, style), len(spans)) == plain.redact(text, rules, style)
        assert all(0 <= s.start <= s.end <= len(text) for s in spans)


def test_boxes_lie_where_they_were(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = {r["doc_id"]: (r["text"], r["redacted"]) for r in redact(docs, detector_rules()).collect()}
    spans = {}
    for r in redaction_spans(docs, detector_rules()).collect():
        spans.setdefault(r["doc_id"], []).append(r)
        assert (r["at"], r["size"]) == (r["start"], r["end"] - r["start"])
    for doc, (text, redacted) in done.items():
        chars = list(text or "")
        for r in spans.get(doc, ()):
            chars[r["start"] : r["end"]] = "█" * (r["end"] - r["start"])
        assert "".join(chars) == (redacted or "")
    assert spans


def test_marks_lead_back_to_what_they_cover(spark):
    rules = build_rules(["Email addresses"], ["redacted", "x [redacted] y"])
    text = "é x a@b.co y 🎈"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "none")], "id int, text string")
    rows = [tuple(r) for r in redaction_spans(df, rules, "label").collect()]
    assert rows == [(1, 1, 4, 6, 4, 10), (1, 2, 5, 8, 4, 10)]
    whole = build_rules(["Email addresses"], ["x [redacted] y"])
    assert [tuple(r)[1:] for r in redaction_spans(df, whole, "label").collect()] == [(1, 4, 6, 4, 10), (2, 2, 14, 2, 12)]


def test_partial_leaks(spark):
    df = spark.createDataFrame([(1, "card 4785380592391139."), (2, "mail a@b.co"), (3, None)], "id int, text string")
    rules = detector_rules()
    card = [r.label for r in rules].index("Credit card numbers") + 1
    found = [tuple(r) for r in partial_leaks(df, rules).collect()]
    assert (1, card, 5, 3, 5, 21) in found and {r[0] for r in found} == {1}
