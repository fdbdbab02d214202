"""Main text of HTML pages by composite text density.

A page becomes a tree without the elements that are boilerplate by their name (scripts, styles, forms, menus,
headers, footers, asides), which are left out with all they hold. For each node with C characters
and T tags, of which LC and LT lie in links, the density is

    C / T * log(C / LC * T / LT) / log(e + C / (C - LC) * LC + LCb / Cb * C)

(zero counts as one; b is the body). The node whose children's densities have the largest sum is the
core (inline children such as b are no blocks of their own and add nothing; of equal sums an article or main
is taken); the smallest density on its way up to the body is the threshold. The text is the core together with the
neighbours of its path that reach the threshold.

A class, id or role with a word such as ad, comments or sidebar marks a node. Below a mark densities count a
tenth, and a marked node whose tenth is under the threshold is left out; the rest is weighed again. A mark says
nothing where an article or main lies below it, and a node that holds the core, counted with or
without marks, is never left out.

Each page is read on its own by one narrow Arrow stage; nothing is shuffled. A null or empty html and a
page without text give "". Other columns of the input are left alone; repeated rows give repeated rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelframe.llm.base import table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!/?a-zA-Z][^<]*+\Z", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAMED = re.compile(r"[a-z]+|[A-Z][a-z]*")

# Names of HTML elements by what they do.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIPPED = {"head", "script", "style", "title", "noscript", "template", "nav", "header", "footer", "aside", "form", "button",
           "select", "textarea", "iframe", "object", "svg", "canvas", "dialog", "menu", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
          "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
          "u", "var", "wbr", "br"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer",
            "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",)}
SCOPES = {"ul", "ol", "dl", "table", "article", "body", "div", "section", "main"}
# Words in class, id and role that mark what is seldom the article, and what its densities count.
LOWERED = 0.1
MARKS = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "banner", "footer", "contentinfo",
         "sidebar", "aside", "complementary", "notice", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "ad", "ads", "advert",
         "adverts", "advertisement", "sponsor", "sponsored", "promo", "comment", "comments", "disqus", "replies", "share", "sharing",
         "social", "related", "newsletter", "subscribe", "pagination", "pager", "search", "login", "signup"}


class Node:
    __slots__ = ("tag", "parent", "kids", "chars", "tags", "link_chars", "link_tags", "density", "skip", "linked", "mark", "low")

    def __init__(self, tag: str, parent: Node | None, skip: bool, mark: bool = False):
        self.tag, self.parent, self.skip, self.mark, self.kids = tag, parent, skip, mark, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0
        self.low = False
        self.linked = tag == "a" or parent is not None and parent.linked


def _marked(tag: str, attrs: str) -> bool:
    if "=" not in attrs or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        if name in ("class", "id", "role"):
            if any(w.lower() in MARKS for w in _NAMED.findall(m[2] or m[3] or m[4] or "")):
                return True
    return False


def parse(page: str) -> Node:
    """The tree of a page; text is held as strings among the children of its node."""
    root = here = Node("#root", None, False)
    at, low = 0, None
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            here.kids.append(page[at:])
            break
        if m.start() > at:
            here.kids.append(page[at: m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = here
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            continue
        if tag in CLOSES_P:
            here = _closed(here, ("p",))
        if tag in SIBLINGS:
            here = _closed(here, SIBLINGS[tag])
        node = Node(tag, here, here.skip or tag in SKIPPED, _marked(tag, m[3]))
        here.kids.append(node)
        if tag in RAW:
            low = page.lower() if low is None else low
            if len(low) != len(page):  # a letter whose small form is longer
                low = "".join(c.lower() if c.isascii() else c for c in page)
            end = low.find(f"</{tag}", at)
            end = len(page) if end < 0 else end
            node.skip = True
            at = end
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            here = node
    return root


def _closed(here: Node, tags: tuple[str, ...]) -> Node:
    """Where the parser stands after an implied end of the nearest of `tags`."""
    node = here
    while node is not None and node.tag not in tags:
        if node.tag in SCOPES:
            return here
        node = node.parent
    return here if node is None else node.parent


def _ordered(root: Node) -> list[Node]:
    """Parents before children, without what is left out."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in reversed(node.kids) if not isinstance(k, str) and not k.skip]
    return out


def weigh(root: Node) -> list[Node]:
    nodes = _ordered(root)
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = 0.0
    for node in reversed(nodes):
        for k in node.kids:
            if isinstance(k, str):
                n = len(k.strip())
                node.chars += n
                node.link_chars += n * node.linked
            elif not k.skip:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
    body = next((x for x in nodes if x.tag == "body"), root)
    rate = body.link_chars / max(1, body.chars)
    for node in nodes:
        if node.chars:
            c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
            base = math.log(math.e + c / max(1, c - node.link_chars) * node.link_chars + rate * c)
            node.density = c / t * max(0.0, math.log(c / lc * t / lt)) / base
    return nodes


def _path(nodes: list[Node], marks: bool) -> list[Node]:
    """The core and what encloses it, up to the body."""
    weight = {id(x): LOWERED if marks and x.low else 1.0 for x in nodes}
    totals = [sum(k.density * weight[id(k)] for k in x.kids if not isinstance(k, str) and not k.skip and k.tag not in INLINE) for x in nodes]
    # of equals an article or main, then the first
    path = [nodes[max(range(len(nodes)), key=lambda i: (totals[i], nodes[i].tag in ("article", "main")))]]
    while path[-1].parent is not None and path[-1].tag != "body":
        path.append(path[-1].parent)
    return path


def _unmarked(root: Node) -> tuple[list[Node], list[Node]]:
    """The nodes that stay and the core's path, after marked nodes under the threshold were left out."""
    nodes = weigh(root)
    named = set()
    for node in reversed(nodes):
        if node.tag in ("article", "main") or id(node) in named:
            named |= {id(node), id(node.parent)}
    for node in nodes:
        node.mark = node.mark and id(node) not in named
        node.low = node.mark or node.parent is not None and node.parent.low
    path = _path(nodes, True)
    marked = [x for x in nodes if x.mark]
    if marked:
        held = set(map(id, path)) | set(map(id, _path(nodes, False)))
        threshold = min(x.density for x in path)
        out = [x for x in marked if id(x) not in held and x.density * LOWERED < threshold]
        if out:
            for x in out:
                x.skip = True
            nodes = weigh(root)
            path = _path(nodes, True)
    return nodes, path


def content(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    nodes, path = _unmarked(root)
    if not root.chars:
        return []
    core = path[0]
    threshold = min(x.density for x in path)
    if len(path) > 1 and core.tag not in ("body", "#root"):
        on_path = set(map(id, path))
        chosen = {id(core)} | {id(k) for p in path[1:] for k in p.kids
                               if not isinstance(k, str) and not k.skip and id(k) not in on_path
                               and k.density * (LOWERED if k.low else 1) >= threshold}
        return [x for x in nodes if id(x) in chosen]
    return [core]


def blocks(node: Node) -> list[str]:
    """Text of the blocks below `node`, white space joined, empty ones left out."""
    out, parts, todo = [], [], [node]

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(text)
        parts.clear()

    while todo:
        k = todo.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            parts.append(k)
        elif k.skip:
            continue
        elif k.tag in INLINE:
            if k.tag == "br":
                parts.append(" ")
            todo += reversed(k.kids)
        else:
            flush()
            todo += [None, *reversed(k.kids)]
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(b for node in content(parse(page)) for b in blocks(node))


def extract(pages: DataFrame, text: str = "html") -> DataFrame:
    """page_id, url, text of each page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", F.col(f"`{text}`")).mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
