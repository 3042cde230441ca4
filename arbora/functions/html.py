"""HTML to Markdown: main content, without noise, as blocks, lists, tables and quotes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an opening tag closes if it is still open.
CLOSES = {t: frozenset(("p",)) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()} | {"li": frozenset(("li", "p")), "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "dd": frozenset(("dd", "dt", "p")), "dt": frozenset(("dd", "dt", "p")), "option": frozenset(("option",))}
STOPS = {"li": frozenset(("ul", "ol")), "tr": frozenset(("table", "tbody", "thead")), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table"))}
# Where content is looked for first, and what is noise.
CONTENT_TAGS, CONTENT_IDS = ("article", "main"), ("content",)
CONTENT_CLASSES = ("content", "article", "post", "entry", "post-content", "article-content")
NOISE_TAGS = frozenset("script style noscript iframe header footer nav aside".split())
NOISE_CLASSES = frozenset("ads advert sidebar toolbar comments".split())


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self):
        yield self
        for x in self.children:
            if isinstance(x, Node):
                yield from x.walk()

    def text(self) -> str:
        return "".join(x if isinstance(x, str) else x.text() for x in self.children)


class Builder(HTMLParser):
    """A tree in which unclosed elements end where HTML ends them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        closes, stops = CLOSES.get(tag, ()), STOPS.get(tag, frozenset())
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in stops:
                break
            if self.open[i].tag in closes:
                del self.open[i:]
                break
        if len(self.open) > 400:  # deeper nesting is flattened
            del self.open[400:]
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and len(self.open) > 1:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    b = Builder()
    b.feed(html)
    b.close()
    return b.root


def content(root: Node) -> Node:
    """A usual container, else the div with most paragraphs if it has more than three, else the body."""
    every = list(root.walk())
    for x in every:
        if x.tag in CONTENT_TAGS or x.attrs.get("id") in CONTENT_IDS or any(c in CONTENT_CLASSES for c in x.classes()):
            return x
    divs = [(sum(y.tag == "p" for y in x.walk()), x) for x in every if x.tag == "div"]
    if divs and (best := max(divs, key=lambda d: d[0]))[0] > 3:
        return best[1]
    return body(root)


def body(root: Node) -> Node:
    return next((x for x in root.walk() if x.tag == "body"), root)


def quiet(x: Node) -> Node:
    """A copy without noise."""
    kept = []
    for c in x.children:
        if isinstance(c, Node):
            hidden = "display:none" in c.attrs.get("style", "") or c.attrs.get("role") == "navigation"
            if c.tag in NOISE_TAGS or hidden or NOISE_CLASSES & set(c.classes()):
                continue
            c = quiet(c)
        kept.append(c)
    return Node(x.tag, x.attrs, kept)


def inline(x: Node | str) -> str:
    if isinstance(x, str):
        return re.sub(r"\s+", " ", x)
    inner = "".join(map(inline, x.children))
    bare = inner.strip()
    if x.tag in ("script", "style", "noscript", "iframe", "head"):
        return ""
    if x.tag == "br":
        return "\n"
    if x.tag in ("b", "strong") and bare:
        return f"**{bare}**"
    if x.tag in ("i", "em") and bare:
        return f"*{bare}*"
    if x.tag == "code" and bare:
        return f"`{bare}`"
    if x.tag == "a" and bare:
        return f"[{bare}]({x.attrs['href']})" if x.attrs.get("href") else bare
    if x.tag == "img":
        return f"![{x.attrs.get('alt', '')}]({x.attrs.get('src', '')})" if x.attrs.get("src") else ""
    return inner


def items(x: Node, depth: int = 0) -> list[str]:
    out, n = [], 0
    for c in x.children:
        if not isinstance(c, Node) or c.tag != "li":
            continue
        n += 1
        mark = f"{n}. " if x.tag == "ol" else "- "
        own = "".join(inline(y) for y in c.children if not (isinstance(y, Node) and y.tag in ("ul", "ol"))).strip()
        out.append("  " * depth + mark + own)
        for y in c.children:
            if isinstance(y, Node) and y.tag in ("ul", "ol"):
                out += items(y, depth + 1)
    return out


def rows(x: Node) -> list[str]:
    """A table's lines without outer bars: header cells, or the first row's, then rows of as many cells."""
    cell = lambda c: " ".join(c.text().split())
    lines = [(r, [c for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")]) for r in x.walk() if r.tag == "tr"]
    if not lines:
        return []
    inside = {id(r) for h in x.walk() if h.tag == "thead" for r in h.walk()}
    head = [c for n, (r, cells) in enumerate(lines) for c in cells if c.tag == "th" and (n == 0 or id(r) in inside)]
    body = lines
    if not head:
        head, body = [c for c in lines[0][1] if c.tag == "td"], lines[1:]
    names = [cell(c) for c in head] or [f"Column {i + 1}" for i in range(max(len(cells) for _, cells in lines))]
    out = [" | ".join(names), " | ".join(["---"] * len(names))]
    for _, cells in body:
        if own := [cell(c) for c in cells if c.tag == "td"]:
            out.append(" | ".join(own[: len(names)]) + " | " * max(0, len(names) - len(own)))
    return out if names else []


BLOCKS = frozenset("p div section article main body ul ol table blockquote pre h1 h2 h3 h4 h5 h6 hr header footer nav aside form dl dd dt figure #root html".split())


def blocks(x: Node) -> list[str]:
    if x.tag in ("script", "style", "noscript", "iframe", "head"):
        return []
    if re.fullmatch("h[1-6]", x.tag):
        t = " ".join(inline(x).split())
        return [f"{'#' * int(x.tag[1])} {t}"] if t else []
    if x.tag in ("ul", "ol"):
        return ["\n".join(i)] if (i := items(x)) else []
    if x.tag == "table":
        return ["\n".join(r)] if (r := rows(x)) else []
    if x.tag == "pre":
        return [f"```\n{x.text().strip(chr(10))}\n```"]
    if x.tag == "hr":
        return ["---"]
    if x.tag == "blockquote":
        return ["\n".join(f"> {line}" for line in "\n\n".join(inner(x)).split("\n"))]
    return inner(x)


def inner(x: Node) -> list[str]:
    out, held = [], []

    def flush() -> None:
        text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(held)).strip()
        if text:
            out.append(re.sub(r" {2,}", " ", text))
        held.clear()

    for c in x.children:
        if isinstance(c, Node) and (c.tag in BLOCKS or any(y.tag in BLOCKS for y in c.walk())):
            flush()
            out.extend(blocks(c))
        else:
            held.append(inline(c))
    flush()
    return out


def to_markdown(html: str) -> str:
    """The main content; the whole body if noise leaves less than 100 bytes of it."""
    root = tree(html)
    main = quiet(content(root))
    if len(main.text().strip().encode()) < 100:
        main = body(root)
    return "\n\n".join(blocks(main)).strip()


@F.pandas_udf(T.StringType())
def markdown(pages: pd.Series) -> pd.Series:
    return pages.map(lambda x: None if x is None else to_markdown(x))


def main_text(html: str) -> str:
    """The plain text of the first usual container, or the body, without noise."""
    root = tree(html)
    found = next((x for x in root.walk() if x.tag in CONTENT_TAGS or x.attrs.get("id") in CONTENT_IDS or any(c in CONTENT_CLASSES for c in x.classes())), None)
    return quiet(found or body(root)).text()


@F.pandas_udf(T.StringType())
def main_content(pages: pd.Series) -> pd.Series:
    return pages.map(lambda x: None if x is None else main_text(x))


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    from html import unescape as plain

    return texts.map(lambda x: None if x is None else plain(x))


def title(html: Column) -> Column:
    """The text of the title element, trimmed; entities stay."""
    return F.btrim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), F.lit(" \t\n\r"))
