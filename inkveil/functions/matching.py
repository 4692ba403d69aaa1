"""SQL expressions for single rules, and the Arrow path for the others.

Expressions are SQL strings: a rule chain has dozens of them, and one string
is one call into the JVM where composed ``Column`` objects are dozens.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.dialect import to_java
from inkveil.functions.rules import BOX_MARK, LABEL_MARK, Rule

_DIGITS = "__digits"
# Written around a match while a text is being cut; Unicode noncharacters.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_name(name: str) -> str:
    """A quoted column name."""
    return "`" + name.replace("`", "``") + "`"


def java_pattern(rule: Rule, engine: str = "auto") -> str | None:
    """The rule's pattern for Spark's regex functions; ``None`` sends it to Python."""
    if engine not in ("auto", "python"):
        raise ValueError(f"Unknown engine '{engine}'")
    if engine == "python":
        return None
    return to_java(rule.pattern, rule.case_sensitive, rule.head, rule.run)


def with_clues(df: DataFrame, text: str, rules: Sequence[Rule]) -> DataFrame:
    """Add one boolean: can any digit-based detector match this text at all?

    One pass that fails on the first character test at most positions spares
    clean texts the pass of every such detector.
    """
    digits = sorted({r.clue.digits for r in rules if r.clue and r.clue.digits})
    if not digits:
        return df.withColumn(_DIGITS, F.lit(True))
    pattern = to_java(f"(?:{'|'.join(digits)})", head=r"\d")
    return df.withColumn(_DIGITS, F.expr(f"{text} RLIKE {sql_text(pattern)}"))


def possible(rule: Rule, text: str) -> str:
    """Whether the rule can match; true for rules without a clue."""
    if rule.clue is None:
        return "true"
    return f"contains({text}, {sql_text(rule.clue.literal)})" if rule.clue.literal else _DIGITS


def count_of(rule: Rule, java: str, text: str) -> str:
    """Number of non-overlapping matches."""
    return f"IF({possible(rule, text)}, regexp_count({text}, {sql_text(java)}), 0)"


def marked(rule: Rule, java: str, style: str, text: str) -> str:
    """The text with its matches marked: the one regex pass.

    For labels a match becomes one marking character; for boxes, whose length
    is the match's, it stands between two of them.
    """
    around = sql_text(_OPEN if style == "label" else f"{_OPEN}$0{_CLOSE}")
    found = f"regexp_replace({text}, {sql_text(java)}, {around})"
    return f"IF({possible(rule, text)}, {found}, {text})"


def hits_in(rule: Rule, java: str, style: str, mark: str, text: str) -> str:
    """How many matches were marked: by the marks' number, or two characters more for each."""
    if style == "label":
        marks = f"length({mark}) - length(replace({mark}, {sql_text(_OPEN)}, ''))"
        again = f"regexp_count({text}, {sql_text(java)})"
        number = f"IF(contains({text}, {sql_text(_OPEN)}), {again}, {marks})"
    else:
        number = f"CAST((length({mark}) - length({text})) / 2 AS INT)"
    return f"IF({possible(rule, text)}, {number}, 0)"


def rewritten(java: str, style: str, text: str, mark: str) -> str:
    """The text with every match replaced by its mark, made from the marked text.

    A box is one block per code point of the match.  A text that happens to
    hold a marking character is matched again instead.
    """
    opened, closed, pattern = sql_text(_OPEN), sql_text(_CLOSE), sql_text(java)
    if style == "label":
        label = sql_text(LABEL_MARK)
        again = f"regexp_replace({text}, {pattern}, {label})"
        return f"IF(contains({text}, {opened}), {again}, replace({mark}, {opened}, {label}))"
    mark_of_piece = f"repeat({sql_text(BOX_MARK)}, instr(piece, {closed}) - 1)"
    blocks = f"coalesce(repeat({sql_text(BOX_MARK)}, length(hit)), '')"
    again = (
        f"array_join(zip_with(split({text}, {pattern}, -1),"
        f" regexp_extract_all({text}, {pattern}, 0),"
        f" (gap, hit) -> concat(gap, {blocks})), '')"
    )
    cut = (
        f"array_join(transform(split({mark}, {opened}, -1), (piece, at) -> IF(at = 0, piece,"
        f" concat({mark_of_piece}, substring_index(piece, {closed}, -1)))), '')"
    )
    return f"IF(contains({text}, {opened}) OR contains({text}, {closed}), {again}, {cut})"


def _sources(rules: Sequence[Rule]) -> list[tuple[str, int]]:
    """Rules as plain values, so that workers need not import this package."""
    return [(rule.pattern, rule.flags) for rule in rules]


def python_counts(rules: Sequence[Rule]):
    """Arrow UDF: text -> matches per rule, by Python's ``re``."""
    sources = _sources(rules)

    def counts(texts: pa.Array) -> pa.Array:
        compiled = [re.compile(*source) for source in sources]
        found = ([sum(1 for _ in p.finditer(t.as_py())) for p in compiled] for t in texts)
        return pa.array(found, type=pa.list_(pa.int32()))

    return F.arrow_udf(counts, "array<int>")


def python_rewrite(rules: Sequence[Rule], style: str):
    """Arrow UDF: text -> rewritten text and number of substitutions; a text at a time."""
    sources, box, label = _sources(rules), BOX_MARK, LABEL_MARK

    def rewrite(texts: pa.Array) -> pa.Array:
        mark = label if style == "label" else (lambda m: box * (len(m[0]) or 1))
        compiled = [re.compile(*source) for source in sources]

        def done(text: str) -> dict:
            total = 0
            for pattern in compiled:
                text, n = pattern.subn(mark, text)
                total += n
            return {"text": text, "n": total}

        return pa.array((done(t.as_py()) for t in texts), type=pa.struct([("text", pa.string()), ("n", pa.int32())]))

    return F.arrow_udf(rewrite, "text string, n int")
