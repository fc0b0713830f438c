"""Text of HTML that keeps its structure, by one scan over tags and the text between them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"<[^>]+>")
_HEADING, _ITEM, _BREAK = re.compile(r"<h([1-6])[^>]*>", re.I), re.compile(r"<li[^>]*>", re.I), re.compile(r"<br\s*/?>", re.I)
_NEXT_CELL = re.compile(r"\s*<t[dh][^>]*>", re.I)
#: Tags that end a block or a line, and what stands for them. Fixed values.
_ENDS = {f"</{name}>": "\n\n" for name in ("p", "div", "ul", "ol", "blockquote")} | {"</tr>": "\n"}
#: Entities and their characters. Fixed values.
_ENTITY = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
_ENTITIES = re.compile("|".join(_ENTITY))
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_SILENT = re.compile(r"<(script|style)[^>]*>.*?</\1>", re.I | re.S)


class _Scan:
    """A position in a document, and what is known of the closing tags ahead."""

    def __init__(self, html: str):
        self.html, self.lower, self.at = html, html.translate(_LOWER), 0
        self.unclosed: set[str] = set()

    def close(self, tag: str) -> int:
        """Where the next ``tag`` begins, or -1; once there is none, it is not sought again."""
        if tag in self.unclosed:
            return -1
        found = self.lower.find(tag, self.at)
        if found < 0:
            self.unclosed.add(tag)
        return found

    def heading(self, level: str) -> str | None:
        """The heading that has just been opened as a line of its own, or None if it is never closed."""
        end = self.close(f"</h{level}>")
        if end < 0:
            return None
        title, self.at = _one_line(self.html[self.at : end]), end + 5
        return f"\n\n{'#' * int(level)} {title}\n\n"

    def item(self) -> str | None:
        """The list item that has just been opened as a line; its tags say nothing, but for headings in it."""
        begin, parts = self.at, []
        while self.close("</li>") >= 0:
            tag = _TAG.search(self.html, self.at)
            parts.append(self.html[self.at : tag.start()])
            self.at = tag.end()
            heading = _HEADING.fullmatch(tag[0])
            if tag[0].lower() == "</li>":
                return f"\n- {_one_line(''.join(parts))}"
            if heading:
                parts.append(self.heading(heading[1]) or "")
        self.at = begin
        return None

    def parts(self) -> Iterator[str]:
        while tag := _TAG.search(self.html, self.at):
            yield self.html[self.at : tag.start()]
            self.at = tag.end()
            name = tag[0].lower()
            if heading := _HEADING.fullmatch(tag[0]):
                yield self.heading(heading[1]) or ""
            elif _ITEM.fullmatch(tag[0]):
                yield self.item() or ""
            elif _BREAK.fullmatch(tag[0]):
                yield "\n"
            elif name in ("</td>", "</th>") and (cell := _NEXT_CELL.match(self.html, self.at)):
                self.at = cell.end()
                yield " | "
            else:
                yield _ENDS.get(name, "")
        yield self.html[self.at :]


def _one_line(html: str) -> str:
    return " ".join(_TAG.sub("", html).split())


def structured_text(html: str, drop_scripts: bool = False) -> str:
    """Headings as lines after hashes, items after a dash, cells of a row apart by bars, blocks apart by an empty line."""
    made = "".join(_Scan(_SILENT.sub("", html) if drop_scripts else html).parts())
    shown = _ENTITIES.sub(lambda m: _ENTITY[m[0]], made)
    lines = "\n".join(re.sub(r"[ \t]{2,}", " ", line).rstrip() for line in shown.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", lines).strip()


def html_to_text(html: Column, drop_scripts: bool = False) -> Column:
    """``structured_text`` of a column; null stays null. A tag reaches from ``<`` to the next ``>``, whatever stands between."""

    @F.arrow_udf("string")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else structured_text(x, drop_scripts) for x in batch.to_pylist()], pa.string())

    return apply(html)
