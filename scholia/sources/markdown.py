"""Markdown as ordered blocks: headings, list items and paragraphs with the lines they cover.

Each text is read line by line with a stack of the open containers (quotes, list items), as CommonMark defines its blocks: a line
first goes on with the containers that it matches, then opens new ones, and what is left is a heading, code, a rule, a tag block or text, which goes on
with an open paragraph even where containers are missed. Code, tags and rules give no block; link definitions that begin a paragraph
belong to none. A paragraph is a list item's while the list that was opened last is open: behind a list that was nested, the rest of the outer list
are paragraphs.

A text is scanned in one pass in one task, and no two texts meet, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FENCE = re.compile(r"(`{3,})[^`]*$|(~{3,})")
HEADING = re.compile(r"(#{1,6})([ \t]+|$)")
CLOSING = re.compile(r"(^|[ \t]+)#+[ \t]*$")
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ITEM = re.compile(r"([-*+]|([0-9]{1,9})[.)])(?=[ \t]|$)")
UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
DEFINITION = re.compile(r"\[(?:[^\[\]\\]|\\.)*[^\s\[\]\\](?:[^\[\]\\]|\\.)*\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)(?:[ \t]*\n?[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*(?:\n|$)")
# Names of the tags that open a block of their own, and how the other tag blocks begin and end.
BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table "
    "tbody td tfoot th thead title tr track ul"
)
TAGS = [
    (re.compile(r"<(script|pre|style|textarea)(\s|>|$)", re.I), re.compile(r"</(script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?({'|'.join(BLOCK_TAGS.split())})(\s|/?>|$)", re.I), re.compile(r"^\s*$")),
]
_VALUE = r"""\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*")"""
#: A whole tag alone on its line, which doesn't interrupt a paragraph.
LONE_TAG = (re.compile(rf"(<[A-Za-z][A-Za-z0-9-]*(\s+[A-Za-z_:][\w.:-]*({_VALUE})?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"), re.compile(r"^\s*$"))

#: Characters of the texts whose blocks a task holds at once.
HELD = 1 << 20

Block = tuple[str, int, str | None, str, int, int]


class Line:
    """What is left of a line: its text from `at`, and the column there, as tabs reach to the next multiple of four."""

    def __init__(self, text: str):
        self.text, self.at, self.column = text, 0, 0

    def indent(self) -> int:
        """Columns of white space ahead."""
        column = self.column
        for c in self.text[self.at :]:
            if c == " ":
                column += 1
            elif c == "\t":
                column += 4 - column % 4
            else:
                break
        return column - self.column

    def skip(self, columns: int) -> None:
        """Goes past that many columns of white space; a tab that reaches beyond leaves spaces."""
        end = self.column + columns
        while self.column < end and self.at < len(self.text) and self.text[self.at] in " \t":
            wide = 1 if self.text[self.at] == " " else 4 - self.column % 4
            self.at += 1
            self.column += wide
        if self.column > end:
            self.text, self.at, self.column = " " * (self.column - end) + self.text[self.at :], 0, end

    def take(self, n: int) -> None:
        """Goes past n characters that aren't white space."""
        self.at += n
        self.column += n

    @property
    def rest(self) -> str:
        return self.text[self.at :]


class Scanner:
    """The blocks of one text. `stack` holds the width of each open list item (0: an item that began blank) with its marker, or None for a quote."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.stack: list[tuple[int, str] | None] = []
        self.listed: str | None = None
        self.paragraph: list[str] = []
        self.first = 0
        self.fence: tuple[str, int] | None = None
        self.tag: re.Pattern | None = None
        self.fresh = False  # the last item has no line yet but its marker's

    def scan(self, text: str) -> list[Block]:
        """(kind, level, list_kind, text, first line, last line) of every block."""
        lines = text.split("\n")
        for n, line in enumerate(lines):
            self.line(n, Line(line))
        self.end(len(lines) - 1)
        return self.blocks

    def end(self, last: int, level: int = 0) -> None:
        """Ends the open paragraph with line `last`; as a heading, if a level is given."""
        if not self.paragraph:
            return
        text = "\n".join(self.paragraph)
        while not level and (found := DEFINITION.match(text.lstrip())):
            text = text.lstrip()
            self.first += text[: found.end()].count("\n")
            text = text[found.end() :]
        if text.strip():
            kind = "heading" if level else "list_item" if self.listed else "paragraph"
            self.blocks.append((kind, level, None if level else self.listed, text.strip(), self.first, last))
        self.paragraph = []

    def close(self, keep: int, n: int) -> None:
        """Closes the containers above the first `keep`, and what is open in them."""
        self.end(n - 1)
        if any(self.stack[keep:]):
            self.listed = None
        if len(self.stack) > keep:
            self.fence = self.tag = None
        del self.stack[keep:]

    def matched(self, line: Line) -> int:
        """How many of the open containers the line goes on with; it is moved behind their marks."""
        for k, container in enumerate(self.stack):
            blank = not line.rest.strip(" \t")
            if container is None:
                if line.indent() > 3 or not line.rest.lstrip(" \t").startswith(">"):
                    return k
                self.quoted(line)
            elif blank:
                if self.fresh and k == len(self.stack) - 1:
                    return k  # an item that began blank ends at a blank line
            elif line.indent() >= container[0]:
                line.skip(container[0])
            else:
                return k
        return len(self.stack)

    def quoted(self, line: Line) -> None:
        """Goes past a quote's mark and the space behind it."""
        line.skip(line.indent())
        line.take(1)
        if line.rest[:1] in (" ", "\t"):
            line.skip(1)

    def line(self, n: int, line: Line) -> None:
        """Takes the next line."""
        k = self.matched(line)
        whole = k == len(self.stack)
        rest = line.rest.strip(" \t\r")
        if whole and self.fence:
            mark, size = self.fence
            if line.indent() < 4 and len(rest) >= size and not rest.strip(mark):
                self.fence = None
            return
        if whole and self.tag:
            if self.tag.search(line.rest):
                self.tag = None
            return
        if not rest:
            self.end(n - 1)
            if not whole:
                self.close(k, n)
            return
        self.fresh = self.fresh and not whole
        while line.indent() < 4:
            rest = line.rest.lstrip(" \t").rstrip("\r")
            whole = k == len(self.stack)
            continues = whole and bool(self.paragraph)
            item = None if RULE.match(rest) else ITEM.match(rest)
            if rest.startswith(">"):
                self.close(k, n)
                self.stack.append(None)
                self.quoted(line)
            elif item and not (continues and (not rest[item.end() :].strip() or item[2] and int(item[2]) != 1)):
                self.item(n, k, line, item)
                if not line.rest.strip(" \t\r"):
                    return
            else:
                break
            k = len(self.stack)
        rest = line.rest.lstrip(" \t").rstrip("\r")
        whole = k == len(self.stack)
        if line.indent() >= 4:
            if not self.paragraph:
                self.close(k, n)  # code
                return
        elif heading := HEADING.match(rest):
            self.close(k, n)
            self.blocks.append(("heading", len(heading[1]), None, CLOSING.sub("", rest[heading.end() :]).strip(), n, n))
            return
        elif fence := FENCE.match(rest):
            self.close(k, n)
            mark = fence[1] or fence[2]
            self.fence = mark[0], len(mark)
            return
        elif end := self.tagged(rest, bool(self.paragraph)):
            self.close(k, n)
            self.tag = None if end.search(rest) else end
            return
        elif whole and self.paragraph and UNDERLINE.match(rest):
            self.end(n, 1 if rest[0] == "=" else 2)
            return
        elif RULE.match(rest):
            self.close(k, n)
            return
        if not self.paragraph:  # else it goes on, even if containers are missed
            self.close(k, n)
            self.first = n
        self.paragraph.append(line.rest if self.paragraph else rest)

    def item(self, n: int, k: int, line: Line, found: re.Match) -> None:
        """Opens a list item: of the list that the first container missed belongs to, if the marks are alike, else of a new list."""
        before = line.indent()
        line.skip(before)
        line.take(found.end())
        after = line.indent()
        blank = not line.rest.strip(" \t\r")
        wide = 1 if blank or after > 4 else after
        mark = found[1][-1]
        own = self.stack[k] if k < len(self.stack) else None
        if own and own[1] == mark:
            self.close(k + 1, n)  # the items nested in it
            self.end(n - 1)
            self.fence = self.tag = None
            self.stack.pop()
        else:
            self.close(k, n)
            self.listed = "ordered" if found[2] else "bullet"
        self.stack.append((before + found.end() + wide, mark))
        self.fresh = blank
        if not blank:
            line.skip(wide)

    def tagged(self, rest: str, goes_on: bool) -> re.Pattern | None:
        """What ends the tag block that the line opens."""
        if rest[0] != "<":
            return None
        kinds = TAGS if goes_on else [*TAGS, LONE_TAG]
        return next((end for begin, end in kinds if begin.match(rest)), None)


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, ord, kind, level, list_kind, text, lo, hi of `docs(doc_id, text)`; lo and hi: the block's lines in the text.

    Null and empty texts have no blocks.
    """

    names = ["doc_id", "ord", "kind", "level", "list_kind", "text", "lo", "hi"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                if text:
                    ends = [-1]
                    for line in text.split("\n"):
                        ends.append(ends[-1] + 1 + len(line))
                    rows += [(i, k, kind, level, listed, said, ends[a] + 1, ends[b + 1]) for k, (kind, level, listed, said, a, b) in enumerate(Scanner().scan(text))]
                    size += len(text)
                if rows and (size >= HELD or i == batch.num_rows - 1):
                    at, *columns = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *map(pa.array, columns, kinds)], names)
                    rows, size = [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ord long, kind string, level long, list_kind string, text string, lo long, hi long")
