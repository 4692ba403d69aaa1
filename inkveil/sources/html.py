"""The text of an HTML page as Markdown, in one pass from left to right.

A tag ends at the first ``>`` outside a quoted attribute value, scripts and
styles at their own end tag, and lists, tables and preformatted text know how
deep they are nested.  Every step goes forward, and what a search has found to
be missing is not searched for again, so the time is linear in the page
whatever it holds.  Character references are left as they are.
"""

from __future__ import annotations

import re

# White space that has to survive the squeezing of blanks; Unicode noncharacters.
KEPT = {" ": "﷐", "\n": "﷑", "\t": "﷒"}
_PROTECT = str.maketrans(KEPT)
DEEPEST = 12  # lists nested deeper are indented like this one
_BLANKS = re.compile(r"[ \t\r\n\f]+")
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>=]")
_START = re.compile(r"""\bstart\s*=\s*["']?(\d{1,9})""", re.IGNORECASE)
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in ("script", "style", "title", "textarea", "xmp")}
_HIDDEN = {"script", "style"}
_HEADINGS = {f"h{i}": "#" * i + " " for i in range(1, 7)}
_BLOCKS = set("address article aside blockquote div footer header main nav p section".split())


class _Page:
    """What has been written so far, and where in the page that is."""

    def __init__(self, html: str):
        self.html, self.out = html, []
        self.last = {sign: html.rfind(sign) for sign in ">\"'"}
        self.lists: list[list] = []  # [numbered, next number]
        self.tables: list[list] = []  # [rows, cells of the open row or None]
        self.pre, self.hidden = 0, False

    def find(self, sign: str, at: int) -> int:
        """The next ``sign``; -1 without a search where none is left."""
        return self.html.find(sign, at) if at <= self.last[sign] else -1

    def tag_end(self, at: int) -> int:
        """Behind the ``>`` of a tag whose name ends at ``at``; -1 if it never ends."""
        while at <= self.last[">"]:
            stop = _STOP.search(self.html, at)
            if stop[0] == ">":
                return stop.end()
            at = _BLANKS.match(self.html, stop.end()).end() if self.html[stop.end()] in " \t\r\n\f" else stop.end()
            quote = self.html[at : at + 1]
            if quote in ("'", '"') and (closed := self.find(quote, at + 1)) >= 0:
                at = closed + 1
        return -1

    def text(self, text: str) -> None:
        if not self.hidden:
            self.out.append(text.translate(_PROTECT) if self.pre and not self.tables else _BLANKS.sub(" ", text))

    def line(self, n: int, mark: str = "") -> None:
        """At least ``n`` line ends; in a table cell there are none."""
        if not self.hidden:
            self.out.append(" " if self.tables else "\n" * n + mark)

    def item(self) -> None:
        if not self.lists:
            return self.line(1, "- ")
        numbered, number = self.lists[-1]
        self.lists[-1][1] += 1
        self.line(1, KEPT[" "] * 2 * min(len(self.lists) - 1, DEEPEST) + (f"{number}. " if numbered else "- "))

    def row_end(self) -> None:
        """Close the open row of the outermost table; the first one is the heading."""
        table = self.tables[-1]
        if len(self.tables) == 1 and table[1] is not None:
            if table[1]:
                self.out.append(" |\n" + "| --- " * table[1] + "|" if table[0] == 0 else " |")
                table[0] += 1
            table[1] = None

    def table_part(self, name: str, closing: bool) -> None:
        if name == "table" and not closing:
            self.line(2)
            self.tables.append([0, None])
        elif not self.tables:
            self.line(1) if name == "tr" else self.text(" ")
        elif name in ("table", "tr"):
            self.row_end()
            if name == "table":
                self.tables.pop()
                self.line(2)
        elif not closing and len(self.tables) == 1 and not self.hidden:
            cells = self.tables[-1][1]
            self.out.append(" | " if cells else "\n| ")
            self.tables[-1][1] = (cells or 0) + 1
        else:
            self.text(" ")

    def tag(self, name: str, closing: bool, inside: str) -> None:
        if name == "head":
            self.hidden = not closing
        elif name == "body":
            self.hidden = False
        elif name in _HEADINGS:
            self.line(2, "" if closing else _HEADINGS[name])
        elif name in ("ul", "ol") and not closing:
            start = _START.search(inside)
            self.lists.append([name == "ol", int(start[1]) if start else 1])
        elif name in ("ul", "ol"):
            del self.lists[-1:]
            if not self.lists:
                self.line(2)
        elif name == "li" and not closing:
            self.item()
        elif name == "br" and not closing:
            self.out.append(KEPT["\n"]) if self.pre and not self.tables and not self.hidden else self.line(1)
        elif name in _BLOCKS:
            self.line(2)
        elif name in ("dd", "dt"):
            self.line(1)
        elif name in ("table", "tr", "td", "th"):
            self.table_part(name, closing)
        elif name == "pre":
            self.line(2)
            self.pre = max(0, self.pre + (-1 if closing else 1))


def page_markdown(html: str) -> str:
    """Headings, lists, tables, paragraphs and preformatted lines; blanks are not yet squeezed.

    A ``<`` that begins no tag, or one that never ends, is text.  Comments and
    raw elements that are never closed run to the end.
    """
    page, at, size = _Page(html), 0, len(html)
    while at < size:
        opened = _OPEN.search(html, at)
        begin = opened.start() if opened else size
        if begin > at:
            page.text(html[at:begin])
        if begin == size:
            break
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        name = _NAME.match(html, begin + 1)
        if name:
            end = page.tag_end(name.end())
        elif html[begin + 1 : begin + 2] in ("!", "?", "/"):
            end = page.find(">", begin) + 1 or -1
        else:
            end = -1
        if end < 0:
            if not page.hidden:
                page.out.append("<")
            at = begin + 1
            continue
        at = end
        if not name:
            continue
        kind, closing = name[1].lower(), html[begin + 1] == "/"
        page.tag(kind, closing, html[name.end() : end])
        if kind == "pre" and not closing and html[at : at + 1] == "\n":
            at += 1
        if kind in _RAW and not closing:
            close = _RAW[kind].search(html, at)
            inner = html[at : close.start() if close else size]
            if kind not in _HIDDEN:
                page.text(inner)
            at = page.tag_end(close.end()) if close else size
            at = size if at < 0 else at
    while page.tables:
        page.row_end()
        page.tables.pop()
    return "".join(page.out)
