"""Redaction rules: the detector catalog and the user's keywords and regexes.

A rule list is ordered and small, so it lives on the driver and is unrolled
into column expressions.  Nothing here touches data.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Fixed values.  Labels, patterns, defaults, marks and messages below decide
# results and wording and have to stay exactly as they are.
# ---------------------------------------------------------------------------
PATTERNS: dict[str, str] = {
    "Email addresses": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "Phone numbers": r"(?:\+?\d{1,3}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b",
    "Social Security Numbers": r"\b\d{3}-\d{2}-\d{4}\b",
    "Employer Identification Numbers (EINs)": r"\b\d{2}-\d{7}\b",
    "Credit card numbers": r"\b(?:\d[ -]?){13,19}\b",
    "IP addresses": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "Dates (MM/DD/YYYY etc.)": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    "US Passport numbers": r"\b[A-Z]{1,2}\d{6,9}\b",
    "URLs": r"https?://[^\s)>\]]+",
    "Bank / IBAN numbers": r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b",
    "ZIP / Postal codes": r"\b\d{5}(?:-\d{4})?\b",
}
DEFAULT_LABELS = (
    "Email addresses",
    "Phone numbers",
    "Social Security Numbers",
    "Employer Identification Numbers (EINs)",
    "Credit card numbers",
)
STYLES = ("box", "label")
LABEL_MARK = "[REDACTED]"
BOX_MARK = "\u2588"
NO_RULES = "Select at least one detector, or add a custom keyword / regex pattern."
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Clue:
    """Something every match of a detector must contain, cheap to look for.

    ``literal`` is a plain substring (a byte search in the JVM).  ``digits`` is
    a regex fragment that starts with a digit; the fragments of all detectors
    are tested together in one pass.  Marks written by earlier detectors hold
    no digit, ``@`` or ``://`` and are fenced off by brackets or blocks, so a
    clue found in a rewritten text was already in the original text.
    """

    literal: str | None = None
    digits: str | None = None


# What a match contains (clue), what it can start with (head), and the class of
# the unbounded run it starts with (run).
CLUES: dict[str, Clue] = {
    "Email addresses": Clue(literal="@"),
    "Phone numbers": Clue(digits=r"\d{3}[\s.-]?\d{4}"),
    "Social Security Numbers": Clue(digits=r"\d{2}-\d{4}"),
    "Employer Identification Numbers (EINs)": Clue(digits=r"\d{2}-\d{7}"),
    "Credit card numbers": Clue(digits=r"(?:\d[ -]?){13}"),
    "IP addresses": Clue(digits=r"\d\.\d{1,3}\.\d"),
    "Dates (MM/DD/YYYY etc.)": Clue(digits=r"\d[/-]\d{1,2}[/-]\d{2}"),
    "US Passport numbers": Clue(digits=r"\d{6}"),
    "URLs": Clue(literal="://"),
    "Bank / IBAN numbers": Clue(digits=r"\d{2}[A-Z0-9]{10}"),
    "ZIP / Postal codes": Clue(digits=r"\d{5}"),
}
HEADS: dict[str, str] = {
    "Phone numbers": r"[+(\d]",
    "Credit card numbers": r"\d[\d -]{12}",
    "IP addresses": r"\d{1,3}\.\d",
}
RUNS: dict[str, str] = {"Email addresses": "[A-Za-z0-9._%+-]"}


@dataclass(frozen=True)
class Rule:
    """One rewrite: a label to report under and a Python-dialect regex."""

    label: str
    pattern: str
    kind: str = "regex"
    case_sensitive: bool = False
    clue: Clue | None = None
    head: str | None = None
    run: str | None = None

    @property
    def flags(self) -> int:
        return 0 if self.case_sensitive else re.IGNORECASE

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)


def split_lines(block: str | None) -> list[str]:
    """Non-blank lines of a text box, in Python's sense of a line."""
    return [line for line in (block or "").splitlines() if line.strip()]


def detector_rules(labels: Iterable[str] | None = None, case_sensitive: bool = False) -> list[Rule]:
    """Detectors in request order: unknown labels ignored, repeats collapsed.

    ``None`` asks for the whole catalog.
    """
    wanted = dict.fromkeys(PATTERNS if labels is None else labels)
    return [
        Rule(
            label, PATTERNS[label], "detector", case_sensitive,
            clue=CLUES[label], head=HEADS.get(label), run=RUNS.get(label),
        )
        for label in wanted
        if label in PATTERNS
    ]


def keyword_rules(
    keywords: Iterable[str], case_sensitive: bool = False, whole_word: bool = False
) -> list[Rule]:
    """A literal per keyword; repeated keywords stay separate rules."""
    edge = r"\b" if whole_word else ""
    words = [k.strip() for k in keywords]
    return [
        Rule(f'Keyword: "{w}"', edge + re.escape(w) + edge, "keyword", case_sensitive)
        for w in words
        if w
    ]


def regex_rules(expressions: Iterable[str], case_sensitive: bool = False) -> list[Rule]:
    """The user's own regexes, checked before any plan is built."""
    rules = []
    for expression in filter(None, (e.strip() for e in expressions)):
        rule = Rule(f"Custom regex: {expression}", expression, "regex", case_sensitive)
        try:
            rule.compiled()
        except re.error as cause:
            raise ValueError(f"Invalid regex '{expression}': {cause}") from cause
        rules.append(rule)
    return rules


def build_rules(
    labels: Iterable[str] | None = (),
    keywords: Iterable[str] = (),
    expressions: Iterable[str] = (),
    case_sensitive: bool = False,
    whole_word: bool = False,
) -> list[Rule]:
    """Detectors, then keywords, then regexes; that order is the rewrite order.

    No detector is on unless it is named; ``None`` names the whole catalog.
    """
    return [
        *detector_rules(labels, case_sensitive),
        *keyword_rules(keywords, case_sensitive, whole_word),
        *regex_rules(expressions, case_sensitive),
    ]


def rules_from_form(
    labels: Sequence[str] = (),
    keywords: str = "",
    expressions: str = "",
    case_sensitive: bool = False,
    whole_word: bool = False,
) -> list[Rule]:
    """Rules from the text boxes of a form; an empty set is refused."""
    rules = build_rules(
        labels, split_lines(keywords), split_lines(expressions), case_sensitive, whole_word
    )
    if not rules:
        raise ValueError(NO_RULES)
    return rules


def known_style(style: str | None) -> str:
    """Anything but a known style means boxes."""
    return style if style in STYLES else "box"


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The ordered rule list as a table."""
    rows = [(no, r.label, r.kind, r.pattern) for no, r in enumerate(rules, start=1)]
    return spark.createDataFrame(rows, "rule_no int, label string, kind string, pattern string")
