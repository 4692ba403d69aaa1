"""Python regexes on Spark's Java regex functions.

``to_java`` spells a Python pattern so that ``java.util.regex`` finds the same
matches, or returns ``None`` when that cannot be promised; such a rule is then
run by Python's own ``re`` in an Arrow UDF.  Only a plain subset is accepted:
literals, simple classes, ``. ^ $ \\b \\d \\s \\w``, groups, alternation and
ordinary quantifiers.

Python's ``\\d \\s \\w \\b`` are written out as explicit classes.  That is
closer to Python than Java's UNICODE_CHARACTER_CLASS flag (which counts
combining marks as word characters), does not change with the JDK's reading of
``\\b``, and is faster.  What remains is the difference between the Unicode
versions of the two runtimes.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc

DIGIT = r"\p{Nd}"
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
_INSIDE = {r"\d": DIGIT, r"\w": WORD, r"\s": SPACE}
_W = f"[{WORD}]"
_EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"

# A repeated group is matched recursively by Java: long repeats could overflow
# the stack on a long text, so beyond this they are left to Python.
MAX_GROUP_REPEAT = 100

_TOKEN = re.compile(
    r"""(?P<escape>\\(?:[dsw]|[tnrf]|[^\w]))
      | (?P<edge>\\b)
      | (?P<set>\[\^?(?!\])(?:\\(?:[dsw]|[tnrf]|[^\w])|[^\[\]\\])+\])
      | (?P<open>\((?:\?:|(?!\?)))
      | (?P<close>\))
      | (?P<repeat>(?:[*+?]|\{\d+(?:,\d*)?\})\??(?![*+?{]))
      | (?P<anchor>[\^$])
      | (?P<bar>\|)
      | (?P<dot>\.)
      | (?P<char>[^\\\[\](){}*+?^$|.])
    """,
    re.VERBOSE | re.DOTALL,
)
_ESCAPED = re.compile(r"\\.", re.DOTALL)
_SET_ITEM = re.compile(r"\\.|.", re.DOTALL)
_WORD_SET = re.compile(r"\[(?:[A-Z]-[A-Z]|[a-z]-[a-z]|[0-9]-[0-9]|[A-Za-z0-9_]|\\[dw])+\]")


def _plain_case(char: str) -> bool:
    """Whether both engines agree which characters equal this one ignoring case."""
    if char.isascii() or char.lower() == char.upper() == char.casefold():
        return True
    low, up = char.lower(), char.upper()
    return (
        len(low) == len(up) == 1 and low.upper() == up and up.lower() == low == char.casefold()
    )


def _other_case(low: str, high: str) -> str | None:
    """What a range must be joined with to ignore case; ``None`` if unclear."""
    if len(low) > 1 and low[1].isalpha() or len(high) > 1 and high[1].isalpha():
        return None
    first, last = low[-1], high[-1]
    span = [chr(c) for c in range(ord(first), min(ord(last), 127) + 1)]
    letters = {c for c in span if c.isalpha()}
    if letters and not (first.isalpha() and last.isalpha()):
        return None
    if letters == {c.swapcase() for c in letters}:
        return ""
    if len(letters) == len(span) and first.isupper() == last.isupper():
        return f"{first.swapcase()}-{last.swapcase()}"
    return None


def _java_set(token: str, ignore_case: bool) -> str | None:
    """A character set; letter ranges are spelled in both cases.

    Java compares a range with one case of a character only, and would miss
    the Kelvin sign in ``[A-Z]``.
    """
    body = token[1:-1]
    if "&&" in body:
        return None
    if ignore_case and not body.isascii() and ("-" in body or not all(map(_plain_case, body))):
        return None
    negated = body.startswith("^")
    items, spelled = _SET_ITEM.findall(body[negated:]), []
    while items:
        if len(items) > 2 and items[1] == "-":
            other = _other_case(items[0], items[2]) if ignore_case else ""
            if other is None:
                return None
            spelled.append("".join(items[:3]) + other)
            items = items[3:]
        else:
            spelled.append(_INSIDE.get(items[0], items[0]))
            items = items[1:]
    return f"[{'^' * negated}{''.join(spelled)}]"


def _repeat_bounds(token: str) -> tuple[int, float]:
    """The smallest and largest count a quantifier allows."""
    if token[0] != "{":
        return (1 if token[0] == "+" else 0), (1 if token[0] == "?" else float("inf"))
    low, comma, high = re.match(r"\{(\d+)(,?)(\d*)\}", token).groups()
    return int(low), int(high) if high else float("inf") if comma else int(low)


def _only_word(kind: str, token: str) -> bool:
    """Whether a one-character token matches word characters and nothing else."""
    if kind == "set":
        return _WORD_SET.fullmatch(token) is not None
    if kind == "escape":
        return token in (r"\d", r"\w")
    return kind == "char" and (token == "_" or token.isascii() and token.isalnum())


def _tokens(pattern: str) -> list[tuple[str, str]] | None:
    found, at = [], 0
    while at < len(pattern):
        m = _TOKEN.match(pattern, at)
        if m is None:
            return None
        found.append((m.lastgroup, m[0]))
        at = m.end()
    return found


def _may_be_empty(tokens: list[tuple[str, str]]) -> bool:
    bare = "".join("(?:)" if kind in ("edge", "anchor") else text for kind, text in tokens)
    return re.fullmatch(bare, "") is not None


def _java_edge(tokens: list[tuple[str, str]], at: int, ignore_case: bool) -> str:
    """``\\b``, as one look to the side where the other side is known."""
    rest, before = tokens[at + 1 : at + 3], tokens[:at]
    kept = len(rest) < 2 or rest[1][0] != "repeat" or _repeat_bounds(rest[1][1])[0] > 0
    if rest and kept and _only_word(*rest[0]):
        first = _java_token(tokens, at + 1, ignore_case)
        return f"(?={first})(?<!{_W})" if at == 0 else f"(?<!{_W})"
    if before and before[-1][0] == "repeat" and _repeat_bounds(before[-1][1])[0] > 0:
        before = before[:-1]
    return f"(?!{_W})" if before and _only_word(*before[-1]) else _EDGE


def _java_token(tokens: list[tuple[str, str]], at: int, ignore_case: bool) -> str | None:
    kind, token = tokens[at]
    previous = tokens[at - 1][0] if at else "open"
    if kind == "set":
        return _java_set(token, ignore_case)
    if kind == "escape":
        return f"[{_INSIDE[token]}]" if token in _INSIDE else token
    if kind == "edge":
        return _java_edge(tokens, at, ignore_case)
    if kind == "repeat" and previous in ("edge", "anchor", "open", "bar"):
        return None
    if kind == "repeat" and previous == "close" and _repeat_bounds(token)[1] > MAX_GROUP_REPEAT:
        return None
    if kind == "char" and ignore_case and not _plain_case(token):
        return None
    return token


def _spell(pattern: str, ignore_case: bool) -> str | None:
    tokens = _tokens(pattern)
    if tokens is None or _may_be_empty(tokens):
        return None
    parts = [_java_token(tokens, at, ignore_case) for at in range(len(tokens))]
    return None if None in parts else "".join(parts)


def to_java(
    pattern: str, case_sensitive: bool = False, head: str | None = None, run: str | None = None
) -> str | None:
    """The same pattern for Java, or ``None`` if it should stay in Python.

    ``head`` names what a match can start with; it is tested first, so that
    most positions of a text are rejected by one character test.  ``run`` is
    the class of an unbounded run at the start of the pattern: if the start of
    such a run leads to no match, no later place in it does, so only its start
    (or the end of the last match) is tried.  Without that, the time for a run
    of n characters, say a base64 blob, grows with n squared.  Patterns without
    letters go without the case flags, which slow down every class.
    """
    body = _spell(pattern, not case_sensitive)
    if body is None:
        return None
    start = f"(?={_spell(head, not case_sensitive)})" if head else ""
    if run:
        start += f"(?:(?<!{run})|\\G)"
    cased = any(c.lower() != c.upper() for c in _ESCAPED.sub("", pattern))
    return ("(?iud)" if cased and not case_sensitive else "(?d)") + start + body


_ASCII = {r"\d": "0-9", r"\w": "0-9A-Za-z_", r"\s": r"\t-\r\x1c-\x20"}
_BEYOND = r"\x{80}-\x{2587}\x{2589}-\x{10ffff}"  # without the box, which is no digit, letter or blank


def to_re2(pattern: str, case_sensitive: bool = False, loose: bool = False) -> str | None:
    """The same pattern for Arrow's regexes (RE2) on ASCII texts, or ``None`` if that cannot be promised.

    Only printable ASCII patterns of the plain subset without anchors are
    taken, so a control character is to them what a box is: no word, blank or
    letter.  Groups may repeat without bound, as no stack grows with them.

    With ``loose`` it is a pattern for any text that matches in every text in
    which the rule does, and in others: it has no edges, and what may hold for
    some character beyond ASCII holds for all of them.
    """
    tokens = _tokens(pattern)
    if tokens is None or _may_be_empty(tokens) or not (pattern.isascii() and pattern.isprintable()):
        return None
    parts, opened, begun = ["" if case_sensitive else "(?i)"], [], 0
    for at, (kind, token) in enumerate(tokens):
        previous = tokens[at - 1][0] if at else "open"
        if kind == "anchor" or kind == "repeat" and previous in ("edge", "open", "bar"):
            return None
        if kind == "repeat" and previous == "close" and _may_be_empty(tokens[begun:at]):
            return None
        if kind == "open":
            opened.append(at)
            token = "(?:"
        elif kind == "close":
            begun = opened.pop()
        elif kind == "edge" and loose:
            token = ""
        elif kind == "escape" and token in _ASCII:
            token = f"[{_ASCII[token]}{_BEYOND * loose}]"
        elif kind == "char" and loose and not case_sensitive and token.isalpha():
            token = f"[{token}{_BEYOND}]"
        elif kind == "set":
            token = _ESCAPED.sub(lambda m: _ASCII.get(m[0], m[0]), token)
            if loose:
                token = f"(?:{token}|[^\\x00-\\x7f])" if token[1] == "^" else f"(?:{token}|[{_BEYOND}])"
        parts.append(token)
    spelled = "".join(parts)
    try:
        pc.match_substring_regex(pa.array([""]), spelled)
    except pa.ArrowInvalid:  # too many repeats
        return None
    return spelled
