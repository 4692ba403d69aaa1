"""Secret scans: fixed forms of credentials, and stretches of high entropy.

Beside three fixed forms (assignments, access keys, long hexadecimal runs) a
window slides over every candidate string, a run of 20 or more of the
characters that keys are written in.  Per character class the window's Shannon
entropy is kept by counts that change by one character in and one out; windows
above the class's threshold are joined to spans.  Spans that an allow-list
pattern covers are dropped; the allow-list does not touch the fixed forms.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import batches, small_batches

# Fixed values.
KINDS = ("assign", "access", "hex", "entropy")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ALLOWED = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUIDs
    r"(?i).*example.*",  # documentation keys
    r"[A-Z]?[a-z]+(?:[-_/][A-Z]?[a-z]+)*",  # words, paths and slugs
    r"(.)\1*",  # rules of one character
    r"[0-9]+",  # numbers
)


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(
    [_either_case(w) for w in ("password", "passwd", "secret", "token")]
    + [_either_case("api") + "_?" + _either_case("key")]
)
ASSIGN = re.compile(rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


@dataclass(frozen=True)
class CharClass:
    """A class of characters, the window over its runs, and the least entropy in bits."""

    name: str
    pattern: str
    window: int
    bits: float


@dataclass(frozen=True)
class EntropyRules:
    candidate: str = r"[A-Za-z0-9+/_=-]{20,}"
    classes: Sequence[CharClass] = (
        CharClass("hex", r"[0-9a-fA-F]+", 24, 3.2),
        CharClass("alnum", r"[A-Za-z0-9]+", 20, 3.9),
        CharClass("base64", r"[A-Za-z0-9+/_=-]+", 24, 4.1),
    )
    allowed: Sequence[str] = field(default=ALLOWED)


def entropy_windows(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Joined ``(start, end)`` of the windows of ``run`` with at least ``bits`` of entropy.

    With counts c in a window of w characters the entropy is
    log2 w - sum(c log2 c) / w; the sum changes by two terms a step.
    """
    if len(run) < window:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    most = (math.log2(window) - bits) * window + 1e-9
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, char in enumerate(run):
        c = counts.get(char, 0)
        counts[char] = c + 1
        total += term[c + 1] - term[c]
        if i >= window:
            out = run[i - window]
            c = counts[out]
            counts[out] = c - 1
            total += term[c - 1] - term[c]
        start = i - window + 1
        if start >= 0 and total <= most:
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


class Scanner:
    """Finds spans ``(start, rank of kind, end)`` in a text, by start, then kind."""

    def __init__(self, rules: EntropyRules = EntropyRules()):
        self.candidate = re.compile(rules.candidate)
        self.classes = [(re.compile(c.pattern), c.window, c.bits) for c in rules.classes]
        self.allowed = re.compile("|".join(f"(?:{p})" for p in _numbered(rules.allowed)), re.DOTALL)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def entropy(self, text: str) -> list[tuple[int, int, int]]:
        found: list[tuple[int, int]] = []
        for m in self.candidate.finditer(text):
            if self.allowed.fullmatch(m[0]):
                continue
            for pattern, window, bits in self.classes:
                for run in pattern.finditer(m[0]):
                    at = m.start() + run.start()
                    found += [(at + a, at + b) for a, b in entropy_windows(run[0], window, bits)]
        spans: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        return [(a, 3, b) for a, b in spans if not self.allowed.fullmatch(text[a:b])]


def _numbered(patterns: Sequence[str]) -> list[str]:
    """Patterns as parts of one: flags become local, back-references become named."""
    out = []
    for i, p in enumerate(patterns):
        flags = re.match(r"\(\?([ims]+)\)", p)
        body = p[flags.end() :] if flags else p
        body = body.replace("(.)\\1", f"(?P<same{i}>.)(?P=same{i})")
        out.append(f"(?{flags[1]}:{body})" if flags else body)
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_OUT = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(_SPAN))])


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: EntropyRules = EntropyRules(),
) -> DataFrame:
    """``(doc_id, found array<struct<kind, start, end>>)``, one row per row of ``docs``.

    Positions are code points, ends exclusive; spans are ordered by start, then
    by kind as in ``KINDS``.  A NULL text is empty; a NULL id stays NULL;
    repeated rows give repeated rows; an empty table gives none.  Other columns
    are not read.  Texts are scanned where they are: nothing is shuffled, and a
    task holds one batch.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)

        def rows():
            for part in parts:
                for doc, text in zip(part[0].to_pylist(), part[1].to_pylist(), strict=True):
                    text = text or ""
                    found = sorted(scanner.base(text) + scanner.entropy(text))
                    yield doc, [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found]

        yield from batches(rows(), _OUT)

    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return picked.mapInArrow(
        run, "doc_id bigint, found array<struct<kind:string,start:int,end:int>>"
    )


def op3_secret_scan(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract, from the spans of ``scan_secrets``."""
    found = scan_secrets(docs)

    def of(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")

    def line(spans):
        each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(each, ",")

    base = F.filter("found", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
        line(F.col("found")).alias("spans"),
    )
