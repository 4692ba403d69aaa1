import re

import pytest

from inkveil.functions.dialect import to_java
from inkveil.functions.rules import (
    DEFAULT_LABELS,
    NO_RULES,
    PATTERNS,
    build_rules,
    detector_rules,
    keyword_rules,
    known_style,
    regex_rules,
    rules_frame,
    rules_from_form,
    split_lines,
)


def test_catalog_order_and_defaults():
    assert len(PATTERNS) == 11
    assert tuple(PATTERNS)[:5] == DEFAULT_LABELS
    assert [r.label for r in detector_rules()] == list(PATTERNS)


def test_selection_keeps_request_order_and_collapses_repeats():
    rules = detector_rules(["URLs", "nope", "Email addresses", "URLs"])
    assert [r.label for r in rules] == ["URLs", "Email addresses"]


def test_keywords_are_stripped_escaped_and_kept_twice():
    rules = keyword_rules([" a.b ", "", "  ", "a.b"], whole_word=True)
    assert [r.label for r in rules] == ['Keyword: "a.b"'] * 2
    assert rules[0].pattern == r"\ba\.b\b"


def test_order_is_detectors_keywords_regexes():
    rules = build_rules(["URLs"], ["kw"], ["rx"])
    assert [r.kind for r in rules] == ["detector", "keyword", "regex"]


def test_case_flag_covers_detectors():
    (rule,) = detector_rules(["US Passport numbers"])
    assert rule.compiled().search("x1234567")
    (rule,) = detector_rules(["US Passport numbers"], case_sensitive=True)
    assert not rule.compiled().search("x1234567")


def test_invalid_regex_is_named():
    with pytest.raises(ValueError, match=re.escape("Invalid regex '(': ")):
        regex_rules(["ok", " ( "])


def test_empty_rule_set_is_refused():
    with pytest.raises(ValueError, match=re.escape(NO_RULES)):
        rules_from_form(["unknown"], " \n ", "")


def test_lines_split_as_python_does():
    assert split_lines("a\x0bb c\r\n \nd\x85e") == ["a", "b", "c", "d", "e"]


def test_unknown_style_is_box():
    assert [known_style(s) for s in ("box", "label", "BOX", "", None)] == [
        "box", "label", "box", "box", "box",
    ]


def test_rules_as_table(spark):
    rows = rules_frame(spark, build_rules(["URLs"], ["kw"])).orderBy("rule_no").collect()
    assert [(r.rule_no, r.label, r.kind) for r in rows] == [
        (1, "URLs", "detector"),
        (2, 'Keyword: "kw"', "keyword"),
    ]


@pytest.mark.parametrize(
    "pattern",
    ["x*", "a|b|", r"\b", "(?=x)y", "(?P<n>x)", "(?i)x", r"\Ax", r"x\Z", r"(x)\1", "(?:ab)+",
     "(a|b)*c", "a{,3}", "x++", "[[a]", r"\x41", r"\101", r"\N{DASH}", "[]a]", "ß",
     "µ", "[ -~]", "[X-c]", r"[\t-z]", "{", "a{", r"\Dx", "(?:ab){1,500}"],
)
def test_what_stays_in_python(pattern):
    assert to_java(pattern) is None


@pytest.mark.parametrize(
    "pattern", [*PATTERNS.values(), r"C\+\+", "café", r"\bfoo\b", "(a|b){2,5}c?", "^x.$", "a+?b"]
)
def test_what_goes_native(pattern):
    assert to_java(pattern) is not None


@pytest.mark.parametrize(
    "pattern",
    [r"\s", r"[\s.-]", r"[^\s)>\]]", r"\d", r"[\d_]", r"\w", "[A-Z]", "[a-z0-9]", "[^A-Z]", "[i-k]", "[A-z]",
     "[!-/]", "[ks]", "[^i]", r"[\w-]", "[a-c-9]", ".", "k", "i", "s", "é", "ω"],
)
def test_classes_equal_python(spark, pattern):
    """All characters up to the last space one, as far as both runtimes know them."""
    import unicodedata

    chars = [chr(c) for c in range(1, 0x3100) if unicodedata.category(chr(c)) != "Cn"]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    got = {r.c for r in df.filter(df.c.rlike(to_java(pattern))).collect()}
    differ = got ^ {c for c in chars if re.fullmatch(pattern, c, re.IGNORECASE)}
    assert not {c for c in differ if unicodedata.ucd_3_2_0.category(c) != "Cn"}
