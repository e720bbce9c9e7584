"""HTML read as a tree: a stream of tags, a stack that knows what is open, and the text between.

A page is cut into tags, comments and text by one pattern. A fold over these keeps the path of
open elements: an end tag closes up to the element that it names and is passed over if none is
open; an element that cannot hold another of its kind (a paragraph, an item, a cell) is closed by
the next one; elements that have no content are never opened. Scripts, styles and the like are
skipped to their own end tag, whatever stands in them. What is left open at the end is closed there.

The fold takes time in proportion to the page and runs in Arrow batches, as the path is state that
a Column fold would copy at every tag.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import collapse_blank, html_unescape

# Elements without content, and those whose content is no text of the page.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
SKIPPED = ["script", "style", "noscript", "template"]
# Elements that stand on lines of their own and end an open paragraph.
BLOCKS = frozenset(["address", "article", "aside", "blockquote", "dd", "div", "dl", "dt", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "ul"])
# Elements that end an open one of these kinds, and what keeps them from it.
SIBLINGS = {
    "li": (["li"], ["ul", "ol"]), "dt": (["dt", "dd"], ["dl"]), "dd": (["dt", "dd"], ["dl"]), "tr": (["tr"], ["table"]),
    "td": (["td", "th"], ["tr", "table"]), "th": (["td", "th"], ["tr", "table"]), "option": (["option"], ["select"]),
}
#: A comment, a skipped element with all that it holds, a tag, or text; an angle that begins none of these is text.
PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(SKIPPED) + r")\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-z][a-z0-9:-]*+)[^>]*?(/?)>|<[!?][^>]*+>|([^<]++|<)",
    re.IGNORECASE | re.DOTALL,
)

#: Elements that a text is asked about.
ASKED = ("head", "title", "main", "article")


class Open:
    """The open elements of a page, and where those of each name stand in the path."""

    def __init__(self):
        self.path: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[tuple[str, int]] = []

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost open element among ``names``; -1 without one."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def close(self, at: int) -> None:
        """Close the element ``at`` and all below."""
        while len(self.path) > at:
            name = self.path.pop()
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()

    def open(self, name: str, number: int) -> None:
        self.places.setdefault(name, []).append(len(self.path))
        self.path.append(name)
        if name in BLOCKS:
            self.blocks.append((name, number))


class Node(NamedTuple):
    text: str
    inside: tuple[str, ...]  #: of ``ASKED``, those that are open
    block: tuple[str, int]  #: name and number of the innermost element that stands on lines of its own


def nodes(html: str) -> Iterator[Node]:
    """Texts of a page in order, with what is open around each; a break is a line end."""
    tree = Open()

    def node(text: str) -> Node:
        return Node(text, tuple(n for n in ASKED if tree.places.get(n)), tree.blocks[-1] if tree.blocks else ("", -1))

    for number, m in enumerate(PIECE.finditer(html)):
        _, end, name, alone, text = m.groups()
        if text:
            yield node(text)
        if not name:
            continue
        name = name.lower()
        if end:
            at = tree.last([name])
            if at >= 0:
                tree.close(at)
            continue
        if name in BLOCKS:
            at = tree.last(["p"])
            if at >= 0 and tree.last(["table", "button"]) < at:
                tree.close(at)
        if name in SIBLINGS:
            kinds, holders = SIBLINGS[name]
            at = tree.last(kinds)
            if at > tree.last(holders):
                tree.close(at)
        if name in ("br", "hr"):
            yield node("\n")
        if name not in VOID and not alone:
            tree.open(name, number)


def page_title(html: str) -> str:
    """The text of the first ``title`` element, as it stands."""
    out = []
    for n in nodes(html):
        if "title" in n.inside:
            out.append(n.text)
        elif out:
            break
    return "".join(out)


def page_text(html: str) -> str:
    """Text of ``main`` elements, else of ``article`` elements, else of the page without its head; a line a block, headings marked by level."""
    every = list(nodes(html))
    for name in ("main", "article"):
        chosen = [n for n in every if name in n.inside]
        if chosen:
            break
    else:
        chosen = [n for n in every if "head" not in n.inside and "title" not in n.inside]
    out, block = [], ("", -2)
    for n in chosen:
        if n.block != block:
            if not n.text.strip():
                continue
            heading, before = (re.fullmatch("h[1-6]", b[0]) for b in (n.block, block))
            out.append("\n\n" if heading or before else "\n")
            out.append("#" * int(n.block[0][1]) + " " if heading else "")
            block = n.block
        out.append(n.text)
    return "".join(out)


@F.pandas_udf(T.StringType())
def _titles(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in pages:
        yield part.map(lambda p: page_title(p or ""))


@F.pandas_udf(T.StringType())
def _texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in pages:
        yield part.map(lambda p: page_text(p or ""))


def title(html: Column) -> Column:
    """The title of a page on one line, entities read; "" without one."""
    return F.trim(F.regexp_replace(html_unescape(_titles(html)), r"\s+", " "))


def main_markdown(html: Column) -> Column:
    """The main text of a page as markdown, entities read, no more than one empty line at a time."""
    return collapse_blank(F.regexp_replace(html_unescape(_texts(html)), r"[ \t]*\n[ \t]*", "\n"))
