"""The main text of pages against a plain version that builds the tree, and by hand."""

import re
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import pages
from skein.plans import registry
from skein.sources import feeds

LONG = "these are words of a paragraph that goes on for quite a while so that it counts as dense"
FILLER = " ".join(f"filler{k}" for k in range(30))


class Tree(HTMLParser):
    """Blocks in order, from a tree of nodes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [("", None)]  # name, parent
        self.stack = [0]
        self.hidden = None
        self.link = False
        self.words, self.linked = [], []
        self.blocks, self.images = [], []

    def container(self):
        at = self.stack[-1]
        while self.nodes[at][0] in pages.KIND:
            at = self.nodes[at][1]
        return at

    def flush(self):
        words = "".join(self.words).split()
        if words:
            self.blocks.append((self.container(), len(words), len("".join(self.linked).split()), " ".join(words)))
        self.words, self.linked = [], []

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        if tag in pages.HIDDEN:
            self.hidden = tag
        elif tag == "a":
            self.link = True
            self.handle_data(" ")
        elif tag in pages.EMPTY:
            self.handle_data(" ")
            if tag == "img" and dict(attrs).get("src") is not None:
                self.images.append((self.container(), dict(attrs)["src"]))
        elif tag not in pages.INLINE:
            self.flush()
            if tag in pages.KIND:
                for k in range(len(self.stack) - 1, 0, -1):
                    name = self.nodes[self.stack[k]][0]
                    if name not in pages.KIND:
                        break
                    if pages.KIND[name] == pages.KIND[tag]:
                        del self.stack[k:]
                        break
            self.nodes.append((tag, self.stack[-1]))
            self.stack.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        if tag not in pages.HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden:
                self.hidden = None
            return
        if tag == "a":
            self.link = False
            self.handle_data(" ")
        elif tag in pages.EMPTY:
            self.handle_data(" ")
        elif tag not in pages.INLINE and tag not in pages.HIDDEN:
            self.flush()
            self.link = False
            for k in range(len(self.stack) - 1, 0, -1):
                if self.nodes[self.stack[k]][0] == tag:
                    del self.stack[k:]
                    break

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)
            if self.link:
                self.linked.append(data)


def plain(page):
    tree = Tree()
    tree.feed(page)
    tree.close()
    tree.flush()
    good = [b for b in tree.blocks if b[2] <= 0.4 * b[1]]

    def outer(c):
        at = tree.nodes[c][1]
        while at is not None and tree.nodes[at][0] in pages.KIND:
            at = tree.nodes[at][1]
        return at

    total = lambda c, least: sum(b[1] for b in good if b[0] == c and b[1] >= least)
    least = 15 if any(b[1] >= 15 for b in good) else 1
    if not good:
        return [], None
    main = max(sorted({b[0] for b in good}), key=lambda c: total(c, least))
    own = {c for c in {b[0] for b in good} if c == main or (outer(c) == outer(main) and tree.nodes[c][0] == tree.nodes[main][0] and total(c, least) >= 0.25 * total(main, least))}

    def within(c):
        while c is not None:
            if c in own:
                return True
            c = outer(c)
        return False

    return [b[3] for b in good if b[0] in own or (within(b[0]) and b[1] >= 15)], next((src for c, src in tree.images if within(c)), None)


PAGES = [
    f"<html><head><title>{FILLER}</title><script>if (a < b) {{ '<p>{FILLER}</p>' }}</script></head><body><div class=x><ul><li><a href=1>one</a><li><a href=2>two three</a></ul></div>"
    f"<section>an ad of few words</section><div><h1>A headline</h1><p><b>{LONG}<br><p>short one<p>{LONG} &amp; more<img src='pic.jpg'></div><div>Copyright by somebody, all of it</div></body></html>",
    f"<body><p>{LONG}<p>{LONG}<aside>short aside</aside><aside>{LONG} too</aside><div><a href=x>{FILLER}</a> few</div>",
    f"<main><div><p>{LONG}</div><div><p>{LONG} <a href=y>link</a></div><div>no</div><span>inline text</span></main><!-- {LONG} --><footer>{FILLER}</footer>",
    "only a few words <b>here</b>", "", "<p>", "text < 3 and > 2 &lt;p&gt;", f"<a href=z><div>{FILLER}</div></a>", f"</div></p><td>{LONG}<td>x</td></table>", "<IMG SRC=a.png ALT='>'><P>Two words",
]


@pytest.mark.parametrize("page", PAGES)
def test_main_part(page):
    assert pages.main_part(page) == plain(page)


def test_main_part_by_hand():
    lines, image = pages.main_part(PAGES[0])
    assert lines == ["A headline", LONG, "short one", f"{LONG} & more"] and image == "pic.jpg"
    assert pages.main_part(PAGES[1])[0] == [LONG, LONG, f"{LONG} too"]
    assert pages.main_part(PAGES[2].replace(FILLER, "us"))[0] == [LONG, f"{LONG} link"]
    assert pages.main_part("") == ([], None)


TAGS = ["<div>", "</div>", "<p>", "</p>", "<li>", "<ul>", "</ul>", "<a href=x>", "</a>", "<b>", "</b>", "<br>", "<article>", "</article>", "<td>", "<h2>", "</h2>", "<!-- c -->", "<script>x</script>", "<img src='i.png'>", "&amp;", " one two ", f" {LONG} ", f" {FILLER} "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(TAGS), max_size=25))
def test_main_part_of_any_tags(parts):
    assert pages.main_part("".join(parts)) == plain("".join(parts))


def test_main_text_of_pages(spark, tmp_path):
    """The query over a small table: the same shape under other names of tags leaves the same text."""
    nav = "".join(f"<li><a href='/{k}'>{k}</a></li>" for k in "abcdef")
    article = "".join(f"<p>{LONG} {k}</p>" for k in range(5))
    known = f"<nav><ul>{nav}</ul></nav><div class='ad'>Buy this now, it is cheap.</div><article><h1>Title here</h1>{article}</article><footer>&copy; us</footer>"
    other = re.sub("nav|article|footer", "div", known.replace("<ul>", "<div>").replace("</ul>", "</div>"))
    rows = [(1, "u1", known), (2, "u2", other), (3, "u3", None), (4, "u4", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["blocks"], r["text"]) for r in registry.main_text(spark, str(tmp_path)).collect()}
    text = "\n".join(["Title here", *(f"{LONG} {k}" for k in range(5))])
    assert got == {1: (6, text), 2: (6, text), 3: (0, ""), 4: (0, "")}
    taken = {r["url"]: r for r in feeds.extracted(spark.read.parquet(str(tmp_path / "pages.parquet"))).collect()}
    assert taken["u1"]["text"] == text and taken["u1"]["n_lines"] == 8 and taken["u3"]["n_lines"] == 2
    assert taken["u1"]["image_url"] is None
    assert spark.range(1).select(F.size(pages.main_lines(F.lit(known))).alias("n")).first()["n"] == 6
