"""Keyword rules by the table: one sweep over a text however many keywords there are.

A keyword is a literal rule like those of ``keyword_rules``, and the table's
order is the rewrite order: each keyword sees the text its predecessors left.
Instead of a regex pass per keyword, an Aho-Corasick automaton finds all
occurrences of all keywords in one pass, and a sweep in rule order keeps those
that no earlier mark has covered.

Marks can hold keywords, too: ``redacted`` stands in ``[REDACTED]``.  The few
keywords that a mark could complete are looked for in the text as it is at their
turn; where one is found, the sweep starts anew behind it.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.rules import BOX_MARK, LABEL_MARK, Rule, keyword_rules, known_style
from inkveil.plans.layout import with_small_batches
from inkveil.plans.scratch import Staging

# What a worker holds at once: keywords of so many characters, at about a
# hundred bytes each in the automaton.  Longer tables go in several passes.
TABLE_CHARS = 4_000_000


class _Folds(dict):
    """Code point -> a code point that all letters equal to it but for case share.

    It may be shared by more letters; what the automaton finds is checked.
    """

    def __missing__(self, code: int) -> int:
        self[code] = found = ord(chr(code).lower()[0].upper()[0].lower()[0])
        return found


_FOLDS = _Folds()


def folded(text: str) -> str:
    """The text without case, character by character."""
    return text.lower() if text.isascii() else text.translate(_FOLDS)


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


_RUN = re.compile(r"\w+")


def _ranks(held: int | tuple[int, ...]) -> tuple[int, ...]:
    return held if isinstance(held, tuple) else (held,)


class Keywords:
    """An ordered list of keywords, ready to be looked for all at once."""

    def __init__(self, keywords: list[str], style: str = "box", case_sensitive: bool = False, whole_word: bool = False):
        self.mark = LABEL_MARK if style == "label" else BOX_MARK
        self.stretch = style != "label"
        self.whole_word = whole_word
        self.fold = str if case_sensitive else folded
        self.case_sensitive = case_sensitive
        self.words = [k.strip() for k in keywords if k.strip()]
        self.flags = 0 if case_sensitive else re.IGNORECASE
        self.checked: dict[tuple[str, str], bool] = {}
        # Ranks by the word without case: of whole words that are one run of word
        # characters, which are found by that run, and of all others by the automaton.
        self.runs: dict[str, int | tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        for rank, word in enumerate(self.words):
            key = self.fold(word)
            if whole_word and _RUN.fullmatch(word):
                self.runs[key] = (*_ranks(self.runs[key]), rank) if key in self.runs else rank
            else:
                self.automaton.add_word(key, (*_ranks(self.automaton.get(key, ())), rank))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.apart = len(self.automaton) == 0  # no keyword overlaps another
        mark = self.fold(self.mark)
        self.in_marks = [  # what a mark holds, or could be an end of
            rank for rank, word in enumerate(map(self.fold, self.words))
            if word in mark or any(edge in word for edge in (mark[0], mark[-1]))
        ]

    def _rule(self, rank: int) -> Rule:
        """A keyword's rule, made when it is needed: a table has many."""
        return keyword_rules([self.words[rank]], self.case_sensitive, self.whole_word)[0]

    def _equal(self, rank: int, found: str) -> bool:
        word = self.words[rank]
        if self.flags == 0 or (word.isascii() and found.isascii()):
            return True
        key = word, found
        if key not in self.checked:
            if len(self.checked) > 100_000:
                self.checked.clear()
            self.checked[key] = re.fullmatch(re.escape(word), found, self.flags) is not None
        return self.checked[key]

    def _equal_runs(self, text: str) -> Iterator[tuple[list[int], int, int]]:
        """Runs of word characters that are keywords: their ranks, start and end."""
        whole = self.fold(text)
        for run in _RUN.finditer(text):
            start, end = run.span()
            held = self.runs.get(whole[start:end])
            if held is not None and (ranks := [r for r in _ranks(held) if self._equal(r, run[0])]):
                yield ranks, start, end

    def _occurrences(self, text: str, first: int) -> list[tuple[int, int, int]]:
        """``(rank, start, end)`` from rank ``first`` on, by rank and place."""
        whole, found = self.fold(text), []
        if len(self.automaton):
            found += [
                (rank, end + 1 - len(self.words[rank]), end + 1)
                for end, ranks in self.automaton.iter(whole)
                for rank in ranks
                if rank >= first
            ]
        if self.runs:
            for run in _RUN.finditer(text):
                start, end = run.span()
                held = self.runs.get(whole[start:end])
                if held is not None:
                    found += [(rank, start, end) for rank in _ranks(held) if rank >= first]
        found.sort()
        return found

    def _bounded(self, text: str, start: int, end: int, gone: bytearray) -> bool:
        """Whether both ends are word boundaries; what is gone is no word."""
        before = start > 0 and not gone[start - 1] and _is_word(text[start - 1])
        behind = end < len(text) and not gone[end] and _is_word(text[end])
        return before != _is_word(text[start]) and behind != _is_word(text[end - 1])

    def _accepted(self, text: str, own: Iterator[tuple[int, int, int]], gone: bytearray) -> list[tuple[int, int]]:
        """Of one rule's occurrences those that its regex would match, in turn."""
        out, last = [], 0
        for rank, start, end in own:
            if start < last or gone.find(1, start, end) >= 0 or not self._equal(rank, text[start:end]):
                continue
            if self.whole_word and not self._bounded(text, start, end, gone):
                continue
            out.append((start, end))
            last = end
        return out

    def counts(self, text: str) -> dict[str, int]:
        """Matches of each rule on its own, in rule order, equal labels summed."""
        out: dict[str, int] = {}
        if self.apart:
            found = Counter(rank for ranks, _, _ in self._equal_runs(text) for rank in ranks)
            for rank, n in sorted(found.items()):
                label = f'Keyword: "{self.words[rank]}"'
                out[label] = out.get(label, 0) + n
            return out
        none = bytearray(len(text))
        for rank, own in groupby(self._occurrences(text, 0), key=lambda o: o[0]):
            if n := len(self._accepted(text, own, none)):
                label = self._rule(rank).label
                out[label] = out.get(label, 0) + n
        return out

    def redact(self, text: str) -> tuple[str, int]:
        """The text that all rules leave, one after the other, and the number of substitutions."""
        if self.apart and not self.in_marks:
            spans = [(start, end) for _, start, end in self._equal_runs(text)]
            return self._marked(text, spans), len(spans)
        total, first = 0, 0
        while first is not None:
            text, n, first = self._sweep(text, first)
            total += n
        return text, total

    def _sweep(self, text: str, first: int) -> tuple[str, int, int | None]:
        """Rules from ``first`` on, up to one that matches a mark: text, number, and the rule to go on with."""
        spans: list[tuple[int, int]] = []
        gone, now = bytearray(len(text)), None
        risky = set(self.in_marks)
        own = {rank: list(group) for rank, group in groupby(self._occurrences(text, first), key=lambda o: o[0])}
        turns = sorted({*own, *(r for r in self.in_marks if r >= first)})
        for rank in turns:
            if spans and rank in risky:
                now = now or self._marked(text, spans)
                if self.fold(self.words[rank]) in self.fold(now):
                    mark = (lambda m: self.mark * len(m[0])) if self.stretch else (lambda m: self.mark)
                    left, n = self._rule(rank).compiled().subn(mark, now)
                    if n:
                        return left, len(spans) + n, rank + 1
                continue
            accepted = self._accepted(text, own.get(rank, ()), gone)
            for start, end in accepted:
                gone[start:end] = b"\1" * (end - start)
            if accepted:
                spans += accepted
                now = None
        return self._marked(text, spans), len(spans), None

    def _marked(self, text: str, spans: list[tuple[int, int]]) -> str:
        if not spans:
            return text
        parts, at = [], 0
        for start, end in sorted(spans):
            parts += [text[at:start], self.mark * (end - start) if self.stretch else self.mark]
            at = end
        return "".join(parts) + text[at:]


_BUILT: dict[str, Keywords] = {}


def _built(key: str, shared: Broadcast, *options) -> Keywords:
    """The table of a broadcast, built once per worker; only the last one is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Keywords(shared.value, *options)
    return _BUILT[key]


def _passes(keywords: DataFrame, keyword: str, order: str, table_chars: int) -> Iterator[list[str]]:
    """The table in rule order, cut into consecutive parts of at most ``table_chars`` characters (or one keyword).

    Parts are read one after the other, so the driver holds one.
    """
    rows = keywords.filter(F.btrim(keyword) != "").select(F.col(order).alias("o"), F.col(keyword).alias("k"))
    part, size = [], 0
    for row in rows.orderBy("o", "k").toLocalIterator():
        if part and size + len(row["k"]) > table_chars:
            yield part
            part, size = [], 0
        part.append(row["k"])
        size += len(row["k"])
    if part:
        yield part


def redact_keywords(
    df: DataFrame,
    keywords: DataFrame,
    style: str = "box",
    case_sensitive: bool = False,
    whole_word: bool = False,
    keyword: str = "keyword",
    order: str = "rule_no",
    text: str = "text",
    into: str = "redacted",
    n_into: str = "n_redacted",
    table_chars: int = TABLE_CHARS,
    staging: Staging | None = None,
) -> DataFrame:
    """Add the redacted text and the number of substitutions, like ``redact`` with a rule per keyword.

    ``keywords`` is a table of any length; ``order`` is its rewrite order (ties
    by keyword).  Blank and NULL keywords are no rules, repeated ones are rules
    of their own.  Tables of up to ``table_chars`` characters are one pass over
    the texts; longer ones are cut into consecutive parts, which are passes one
    after the other with the texts stored in between (``staging`` holds those
    tables).  No shuffle takes place.  A NULL text stays NULL with count 0.
    """
    spark, style = df.sparkSession, known_style(style)
    staging = staging or Staging(spark)
    kept = [c for c in df.columns if c not in (into, n_into)]
    work = with_small_batches(df).select(*kept, F.col(text).alias("__t"), F.lit(0).alias("__n"))
    for number, part in enumerate(_passes(keywords, keyword, order, table_chars)):
        if number:
            work = staging.store(work, "keywords")
        sweep = _sweeper(spark.sparkContext.broadcast(part), style, case_sensitive, whole_word)
        work = work.withColumn("__done", sweep(F.col("__t"))).withColumns(
            {"__t": F.col("__done.text"), "__n": F.col("__n") + F.coalesce("__done.n", F.lit(0))}
        ).drop("__done")
    return work.select(*kept, F.col("__t").alias(into), F.col("__n").alias(n_into))


def detect_keywords(
    df: DataFrame,
    keywords: DataFrame,
    case_sensitive: bool = False,
    whole_word: bool = False,
    keyword: str = "keyword",
    order: str = "rule_no",
    text: str = "text",
    into: str = "matches",
    table_chars: int = TABLE_CHARS,
    staging: Staging | None = None,
) -> DataFrame:
    """Add ``into``: the list of (label, n) on the original text, in rule order, labels with hits only.

    Longer tables are passes one after the other, as in ``redact_keywords``, so
    that a task has one part of the table at a time.
    """
    staging = staging or Staging(df.sparkSession)
    spark, kind = df.sparkSession, pa.list_(pa.struct([("label", pa.string()), ("n", pa.int32())]))
    kept = [c for c in df.columns if c != into]
    none = F.array().cast("array<struct<label:string,n:int>>")
    work = with_small_batches(df).withColumn("__m", none)
    for number, part in enumerate(_passes(keywords, keyword, order, table_chars)):
        if number:
            work = staging.store(work, "keywords")
        count = _counter(spark.sparkContext.broadcast(part), kind, case_sensitive, whole_word)
        work = work.withColumn("__m", count(F.col(text), F.col("__m")))
    return work.select(*kept, F.col("__m").alias(into))


def _counter(shared: Broadcast, kind: pa.DataType, case_sensitive: bool, whole_word: bool):
    """Arrow UDF: text and the list so far -> the list with one part's counts, equal labels summed."""
    key = uuid.uuid4().hex

    def run(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        table = _built(key, shared, "box", case_sensitive, whole_word)
        done = []
        for text, before in zip(texts.to_pylist(), earlier.to_pylist(), strict=True):
            found = {m["label"]: m["n"] for m in before}
            for label, n in ({} if text is None else table.counts(text)).items():
                found[label] = found.get(label, 0) + n
            done.append([{"label": label, "n": n} for label, n in found.items()])
        return pa.array(done, type=kind)

    return F.arrow_udf(run, "array<struct<label:string,n:int>>").asNondeterministic()


def _sweeper(shared: Broadcast, style: str, case_sensitive: bool, whole_word: bool):
    """Arrow UDF: text -> what one part of the table leaves, and the number of substitutions."""
    key, kind = uuid.uuid4().hex, pa.struct([("text", pa.string()), ("n", pa.int32())])

    def run(texts: pa.Array) -> pa.Array:
        table = _built(key, shared, style, case_sensitive, whole_word)
        done = (None if t is None else table.redact(t) for t in texts.to_pylist())
        return pa.array([None if d is None else {"text": d[0], "n": d[1]} for d in done], type=kind)

    return F.arrow_udf(run, "text string, n int").asNondeterministic()
