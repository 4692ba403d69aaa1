"""Where redactions lie in the original text, carried back through all rules.

While the rules rewrite a text, a piece table says of every stretch of the text
as it is which stretch of the original it stands for: itself, or what a mark
has covered.  So every substitution has its place in the text at its turn and
in the original, even where a rule matches across marks of earlier ones.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.arrow_pass import SPANS, arrow_chain, arrow_spans
from inkveil.functions.matching import java_pattern, sql_name, sql_text
from inkveil.functions.rules import BOX_MARK, LABEL_MARK, Rule, known_style
from inkveil.plans.layout import with_small_batches

Source = tuple[str, int]  # pattern and flags, so that workers need not import rules


class Piece(NamedTuple):
    """``size`` code points that stand for ``start`` to ``end`` of the original."""

    size: int
    start: int
    end: int
    mark: bool


class Span(NamedTuple):
    """One substitution: its rule, its place in the text at its turn, and its place in the original."""

    rule_no: int
    at: int
    size: int
    start: int
    end: int


def _cut(pieces: list[Piece], begins: list[int], low: int, high: int) -> list[Piece]:
    """The pieces of a stretch; of a mark every part stands for all that it covers."""
    out = []
    first = bisect_right(begins, low) - 1
    for i in range(max(first, 0), len(pieces)):
        piece, begin = pieces[i], begins[i]
        if begin >= high:
            break
        a, b = max(low, begin) - begin, min(high, begin + piece.size) - begin
        if a < b:
            out.append(Piece(b - a, piece.start, piece.end, True) if piece.mark else Piece(b - a, piece.start + a, piece.start + b, False))
    return out


def spans_of(text: str, sources: Sequence[Source], style: str) -> list[Span]:
    """Every substitution that the rules make, in order."""
    now, pieces, out = text, [Piece(len(text), 0, len(text), False)], []
    for rule_no, source in enumerate(sources, start=1):
        found = list(re.compile(*source).finditer(now))
        if not found:
            continue
        begins = list(accumulate((p.size for p in pieces), initial=0))[:-1]
        parts, kept, last = [], [], 0
        for match in found:
            low, high = match.span()
            own = _cut(pieces, begins, low, high)
            if own:
                start, end = min(p.start for p in own), max(p.end for p in own)
            else:  # an empty match lies between two pieces, or in one
                before = _cut(pieces, begins, low - 1, low) if low else []
                start = end = before[-1].end if before else 0
            mark = LABEL_MARK if style == "label" else BOX_MARK * ((high - low) or 1)
            out.append(Span(rule_no, low, high - low, start, end))
            kept += [*_cut(pieces, begins, last, low), Piece(len(mark), start, end, True)]
            parts += [now[last:low], mark]
            last = high
        kept += _cut(pieces, begins, last, len(now))
        now, pieces = "".join(parts) + now[last:], kept
    return out


def leaks_of(text: str, sources: Sequence[Source], style: str) -> list[Span]:
    """Matches on the original of which a part was redacted and a part was not: ``at`` and ``size`` of what is left."""
    spans = spans_of(text, sources, style)
    if not spans:
        return []
    covered = bytearray(len(text))
    for span in spans:
        covered[span.start : span.end] = b"\1" * (span.end - span.start)
    out = []
    for rule_no, source in enumerate(sources, start=1):
        for match in re.compile(*source).finditer(text):
            start, end = match.span()
            bare = end - start - covered.count(1, start, end)
            if 0 < bare < end - start:
                out.append(Span(rule_no, covered.find(0, start, end), bare, start, end))
    return out


_DDL = "array<struct<rule_no: int, at: bigint, size: bigint, start: bigint, end: bigint>>"


def _listed(df: DataFrame, rules: Sequence[Rule], style: str, text: str, work) -> DataFrame:
    """``df`` without its text and a row per span; texts in which no rule matches are not sent to Python."""
    sources = [(rule.pattern, rule.flags) for rule in rules]
    style = known_style(style)

    def run(texts: pa.Array) -> pa.Array:
        found = ([] if t is None else [s._asdict() for s in work(t, sources, style)] for t in texts.to_pylist())
        return pa.array(found, type=SPANS)

    javas = [java_pattern(rule) for rule in rules]
    hit = [F.expr(f"{sql_name(text)} RLIKE {sql_text(java)}") if java else F.lit(True) for java in javas]
    some = F.when(reduce(lambda a, b: a | b, hit, F.lit(False)), F.col(text))
    spans = F.arrow_udf(run, _DDL).asNondeterministic()(some)
    kept = [c for c in df.columns if c != text]
    return with_small_batches(df).select(*kept, spans.alias("__spans")).select(*kept, F.inline("__spans"))


def redaction_spans(df: DataFrame, rules: Sequence[Rule], style: str = "box", text: str = "text") -> DataFrame:
    """``df`` without its text, a row per substitution: ``rule_no, at, size, start, end``.

    ``start`` and ``end`` are code points of the original text; ``at`` and
    ``size`` those of the text at the rule's turn, so that the substitutions
    can be done again one after the other.  Boxes are as long as what they
    cover: there ``at`` is ``start``.  Texts without a match, NULL and empty
    ones have no rows.  No shuffle takes place.
    """
    if chain := arrow_chain(rules):
        kept = [c for c in df.columns if c != text]
        spans = arrow_spans(chain, known_style(style), spans_of)(F.col(text))
        return with_small_batches(df).select(*kept, spans.alias("__spans")).select(*kept, F.inline("__spans"))
    return _listed(df, rules, style, text, spans_of)


def partial_leaks(df: DataFrame, rules: Sequence[Rule], style: str = "box", text: str = "text") -> DataFrame:
    """``df`` without its text, a row per match on the original of which a part stays readable.

    ``start`` and ``end`` are the match, ``size`` the code points left and
    ``at`` the first of them: a card number whose tail an earlier rule took.
    """
    return _listed(df, rules, style, text, leaks_of)
