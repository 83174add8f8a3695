"""The main text of a page, by the density of text and links in its parts.

A page is read as one stream of tags and texts.  Texts gather in blocks: a block
ends at any tag that is not inline.  A block belongs to the innermost open
container, an element that is no paragraph, heading, list item or table cell;
those end at the next of their kind, as pages often leave them open.

A block whose share of words in links is over ``LINK_SHARE`` is noise, and one
of ``DENSE`` words or more is dense if it is no noise.  The main container is
the one with most words in dense blocks of its own, or, if no block is dense,
in those that are no noise.  All of its blocks that are no noise count, also
short ones next to the dense, as headlines are; so do those of its siblings of
the same name that have ``SIBLING`` of its words or more; of containers inside
these only the dense blocks count.  No name of a tag makes noise of what it
holds; only what is never shown is left out.

Cases: null and empty pages, and pages of noise only, have no main text; text
outside of tags is in a container of its own; closing tags without an opening
one are ignored; a page of any length is one row.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Fixed value: blocks with a larger share of their words in links are noise.
LINK_SHARE = 0.4

DENSE = 15
SIBLING = 0.25

# Fixed names of the markup: elements that hold no shown text, that are empty, that are inline, that end at the next of their kind.
HIDDEN = {"script", "style", "noscript", "template", "title", "textarea", "svg", "iframe", "select"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
LEAVES = [{"p", "h1", "h2", "h3", "h4", "h5", "h6"}, {"li"}, {"dt", "dd"}, {"td", "th"}, {"option"}]
KIND = {name: k for k, names in enumerate(LEAVES) for name in names}

TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
IMAGE = re.compile(r"""\ssrc\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Blocks:
    """The blocks of a page: (container, words, words in links, text), with the parent and name of each container and its images."""

    def __init__(self, page: str):
        self.found: list[tuple[int, int, int, str]] = []
        self.parent, self.name = {0: -1}, {0: ""}
        self.images: list[tuple[int, str]] = []
        self.open: list[tuple[str, int]] = []  # name of each open element, and its container
        self.texts: list[str] = []
        self.links: list[str] = []
        self.in_link = False
        self.read(page)

    def here(self) -> int:
        return self.open[-1][1] if self.open else 0

    def text(self, part: str) -> None:
        self.texts.append(part)
        if self.in_link:
            self.links.append(part)

    def end_block(self) -> None:
        words = html.unescape("".join(self.texts)).split()
        if words:
            self.found.append((self.here(), len(words), len(html.unescape("".join(self.links)).split()), " ".join(words)))
        self.texts, self.links = [], []

    def start(self, name: str) -> None:
        self.end_block()
        if name in KIND:
            # The last open one of its kind ends, unless a container was opened in it.
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] not in KIND:
                    break
                if KIND[self.open[k][0]] == KIND[name]:
                    del self.open[k:]
                    break
            self.open.append((name, self.here()))
            return
        new = len(self.parent)
        self.parent[new], self.name[new] = self.here(), name
        self.open.append((name, new))

    def close(self, name: str) -> None:
        self.end_block()
        self.in_link = False
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == name:
                del self.open[k:]
                return

    def read(self, page: str) -> None:
        at, hidden = 0, ""
        for m in TAG.finditer(page):
            closing, name = m[1], (m[2] or "").lower()
            if hidden:  # up to its own closing tag
                if closing and name == hidden:
                    hidden, at = "", m.end()
                continue
            self.text(page[at : m.start()])
            at = m.end()
            if not name:
                continue
            if name in HIDDEN:
                hidden = "" if closing or m[3].endswith("/") else name
            elif name == "a":
                self.in_link = not closing
                self.text(" ")
            elif name in EMPTY:
                self.text(" ")
                if name == "img" and (src := IMAGE.search(m[3])):
                    self.images.append((self.here(), html.unescape(src[1] or src[2] or src[3] or "")))
            elif name not in INLINE:
                (self.close if closing else self.start)(name)
        if not hidden:
            self.text(page[at:])
        self.end_block()


def main_part(page: str) -> tuple[list[str], str | None]:
    """(texts of the main blocks in order, address of the first image in their containers)."""
    blocks = Blocks(page)
    quiet = [(of, words, text) for of, words, links, text in blocks.found if links <= LINK_SHARE * words]
    score: dict[int, int] = defaultdict(int)
    for of, words, _ in quiet:
        score[of] += words * (words >= DENSE)
    if not any(score.values()):
        for of, words, _ in quiet:
            score[of] += words
    if not score:
        return [], None
    main = max(score, key=lambda c: (score[c], -c))
    alike = lambda c: (blocks.parent[c], blocks.name[c]) == (blocks.parent[main], blocks.name[main])
    own = {main} | {c for c in score if alike(c) and score[c] >= SIBLING * score[main]}
    inside = set(own)
    for c in blocks.parent:  # parents come before children
        if blocks.parent[c] in inside:
            inside.add(c)
    lines = [text for of, words, text in quiet if of in own or (of in inside and words >= DENSE)]
    return lines, next((src for c, src in blocks.images if c in inside), None)


@pandas_udf(StructType([StructField("lines", ArrayType(StringType())), StructField("image", StringType())]))
def main_parts(pages: pd.Series) -> pd.DataFrame:
    found = [main_part(page or "") for page in pages]
    return pd.DataFrame({"lines": [lines for lines, _ in found], "image": [image for _, image in found]})


def main_lines(page: Column) -> Column:
    """The blocks of a page's main text."""
    return main_parts(page)["lines"]
