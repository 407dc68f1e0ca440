"""Main text of web pages by scoring the element tree.

Elements that show no text go first. Each paragraph then passes points for its
length and its commas to its ancestors, less with every level; an ancestor's
points are discounted by the share of its text that is links, and count BONUS
times in an <article> or <main>. Paragraphs of page furniture (by element, by
role, by the words of class and id) pass none. The container with the most
points is kept. Its siblings are kept where they have at least SHARE of its
points, or read like a part of the text: low in links, and a paragraph, a block
of such, or bare text. So are those of its ancestors, up to the first <article>,
<main> or <body>, but for blocks with less than SHARE of that ancestor's
points. Furniture inside what is kept is left out.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Names of HTML and of common page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("head script style noscript template textarea title xmp iframe noembed noframes button input select option datalist optgroup svg math canvas object embed applet audio video map progress meter".split())
APART = frozenset("nav footer aside form fieldset dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tablist status tooltip".split())
FURNITURE = frozenset(
    (
        "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion promoted nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidepanel rail aside widget widgets footer foot "
        "header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login register social share sharing sharebar comment comments "
        "commentlist disqus reply replies respond discussion related recommended recommendations recirculation pagination pager paywall search searchbox form outbrain taboola skip hidden offscreen legal disclaimer copyright"
    ).split()
)
CONTENT = frozenset("article content main post entry story body text page hentry postcontent maincontent articlebody".split())
#: Parts of compound names that always tell readers' comments, and first parts that tell the layout around something.
REPLIES = frozenset("comment comments commentlist disqus reply replies".split())
WRAPS = frozenset("has no with without is".split())
#: An element with so large a share of the page's text is kept in spite of a compound name.
LARGE = 0.6
#: An open element of the second kind ends where one of the first begins.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",)}
#: The search for such an element stops at these.
SCOPES = frozenset("ul ol dl table div article section main body html aside".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 figcaption".split())
MARKED = frozenset(("article", "main"))
#: Points pass through so many levels; a marked container counts so many times; a sibling needs such a share of its points.
LEVELS, BONUS, SHARE = 6, 3.0, 0.2
#: Least characters of a block without paragraph elements that counts as a paragraph, and of a paragraph that may hold some links.
LEAST_OWN, LEAST_LONG = 25, 80
#: Links may be so much of a sibling's text.
LINKS = 0.25

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|</[^>]*(?:>|\Z)"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<odd>[a-zA-Z][^\s/>]*)(?P<more>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
COMMAS = re.compile("[,،、，]")


class Element:
    __slots__ = ("apart", "attributes", "children", "commas", "holds", "linked", "name", "out", "own", "parent", "points", "size")

    def __init__(self, name: str, attributes: str, parent: Element | None):
        self.name, self.attributes, self.parent, self.children = name, attributes, parent, []
        self.size = self.linked = self.commas = self.own = 0
        self.points = 0.0
        #: Before pruning: whether a marked element is below; after it: whether a paragraph with text is here or below.
        self.holds = False
        #: Furniture by itself, and within such.
        self.out = self.apart = False

    def attribute_map(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(self.attributes):
            found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        return found


def parse(html: str) -> Element:
    """The element tree; what follows an unclosed tag, comment or raw text at the end is left out."""
    root = node = Element("#root", "", None)
    opened: dict[str, int] = {}
    at, n = 0, len(html)

    def close(to: Element) -> Element:
        nonlocal node
        while True:
            opened[node.name] -= 1
            ended, node = node, node.parent
            if ended is to:
                return node

    while at < n:
        m = TOKEN.match(html, at)
        at, kind = m.end(), m.lastgroup
        if kind == "text":
            node.children.append(m[0])
        elif kind == "data":
            node.children.append(m[0][9:].removesuffix("]]>"))
        elif kind == "end":
            name = m["end"].lower()
            if name == "br":
                node.children.append(" ")
            elif opened.get(name, 0):
                to = node
                while to.name != name:
                    to = to.parent
                close(to)
        elif kind in ("rest", "more"):
            name, rest = (m["tag"], m["rest"]) if kind == "rest" else (m["odd"], m["more"])
            if kind == "more" and not m[0].endswith(">"):
                break
            name = name.lower()
            if name in ("html", "body") and opened.get(name, 0):
                continue
            if name not in INLINE and name != "br" and opened.get("p", 0):
                to = node
                while to.name != "p" and to.name not in SCOPES and to.parent:
                    to = to.parent
                if to.name == "p":
                    close(to)
            for ended in ENDS.get(name, ()):
                if opened.get(ended, 0):
                    to = node
                    while to.name != ended and to.name not in SCOPES and to.parent:
                        to = to.parent
                    if to.name == ended:
                        close(to)
            child = Element(name, rest, node)
            node.children.append(child)
            if name in RAW:
                end = RAW_END[name].search(html, at)
                at = html.find(">", end.end()) + 1 or n if end else n
            elif name not in VOID and not (rest.endswith("/") and name not in SCOPES and name != "p" and name in INLINE):
                opened[name] = opened.get(name, 0) + 1
                node = child
    return root


def _given(e: Element) -> dict[str, str]:
    return e.attribute_map() if "=" in e.attributes or "hidden" in e.attributes else {}


def _unseen(e: Element, given: dict[str, str]) -> bool:
    return e.name in UNSEEN or "hidden" in given or given.get("aria-hidden") == "true" or bool(HIDDEN.search(given.get("style", "")))


def _furniture(e: Element, given: dict[str, str], inside: bool, large: bool) -> bool:
    """Whether an element is no part of an article. inside: within an article or main element; large: it holds most of the page's text."""
    if e.name in APART:
        return not (large and e.name in ("form", "fieldset"))
    if e.name == "header" and not inside or given.get("role", "").lower() in ROLES:
        return True
    if not given or e.name in ("html", "body", "main") or e.name == "article" and not inside:
        return False
    names = f"{given.get('class', '')} {given.get('id', '')}".split()
    if any(x.lower() in FURNITURE for x in names):
        return True
    parts = [[w.lower() for w in WORD.findall(x)] for x in names]
    parts = [p for p in parts if p and p[0] not in WRAPS]
    if any(w in REPLIES for p in parts for w in p):
        return True
    if large or any("".join(p) in CONTENT for p in parts):
        return False
    return any(w in FURNITURE for p in parts for w in p)


def _sizes(root: Element) -> int:
    """Sets the text size of every element, what never counts left out, and whether it holds a marked one; returns the root's size."""
    order, waiting = [], [root]
    while waiting:
        e = waiting.pop()
        order.append(e)
        waiting += [c for c in e.children if not isinstance(c, str)]
    for e in reversed(order):
        if e.name not in RAW:
            e.size = sum(len(c.strip()) if isinstance(c, str) else c.size for c in e.children)
        e.holds = any(not isinstance(c, str) and (c.holds or c.name in MARKED) for c in e.children)
        given = e.attributes and e.attribute_map() if "main" in e.attributes or "articleBody" in e.attributes else {}
        if given.get("role") == "main" or given.get("itemprop") == "articleBody":
            e.name = "main"
    return root.size


def _pruned(root: Element) -> list[Element]:
    """Takes what shows no text out of the tree and tells furniture apart; returns what is left, parents first."""
    total = _sizes(root)
    kept, waiting = [], [(root, False)]
    while waiting:
        e, inside = waiting.pop()
        kept.append(e)
        within = inside or e.name in MARKED
        left = []
        for c in e.children:
            if isinstance(c, str):
                left.append(c)
                continue
            given = _given(c)
            if _unseen(c, given):
                continue
            if c.name == "header" and within:
                # An article's own header: its headings belong to the text.
                c.children = [x for x in c.children if not isinstance(x, str) and re.fullmatch("h[1-6]", x.name)]
                given = {}
            # Around the article itself a name tells nothing.
            c.out = _furniture(c, given, within, c.size > LARGE * total) and (c.name in APART or within or not c.holds)
            c.apart = e.apart or c.out
            left.append(c)
            waiting.append((c, within))
        e.children = left
    return kept


def _text(roots: list) -> str:
    """The text of all roots, furniture inside them left out."""
    out: list[str] = []
    waiting: list = list(reversed(roots))
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.name not in INLINE:
            out.append(" ")
            waiting.append(" ")
        waiting += [c for c in reversed(x.children) if isinstance(c, str) or not c.out]
    return " ".join(unescape("".join(out)).split())


def _score(elements: list[Element]) -> None:
    """Sets sizes, links and points of a pruned tree's elements, which come parents first."""
    for e in elements:
        e.size, e.holds = 0, False
    for e in reversed(elements):  # children first
        for c in e.children:
            if isinstance(c, str):
                n = len(c.strip())
                e.size += n
                e.own += n
                e.commas += len(COMMAS.findall(c))
            else:
                e.size += c.size
                e.linked += c.size if c.name == "a" else c.linked
                e.holds |= c.holds
                if c.name in INLINE:
                    e.own += c.own
                    e.commas += c.commas
        e.holds |= _is_paragraph(e)
    for e in elements:
        if _is_paragraph(e) and not e.apart:
            points = (1 + e.commas + min(e.own / 100, 3)) * (1 - e.linked / e.size)
            if e.name not in PARAGRAPHS:
                e.points += points
            level, up = 1, e.parent
            while up is not None and level <= LEVELS:
                up.points += points / (level if level < 3 else 3 * level)
                level, up = level + 1, up.parent
    for e in elements:
        if e.size:
            e.points *= (1 - e.linked / e.size) * (BONUS if e.name in MARKED else 1)


def _is_paragraph(e: Element) -> bool:
    return e.own > 0 and e.size > 0 and e.name not in INLINE and (e.name in PARAGRAPHS or e.own >= LEAST_OWN)


def _container(e: Element) -> bool:
    if not e.size or e.name in INLINE:
        return False
    return e.name not in PARAGRAPHS or e.name == "td" and any(not isinstance(c, str) and c.name == "p" for c in e.children)


def _reads(e: Element) -> bool:
    """Whether a paragraph beside the container belongs to its text."""
    return e.name in PARAGRAPHS and e.name not in ("li", "td") and e.linked <= (LINKS * e.size if e.size >= LEAST_LONG else 0)


def _runs(children: list) -> Iterator[list]:
    """Neighbouring strings and inline elements together, every block by itself."""
    run: list = []
    for c in children:
        if isinstance(c, str) or c.name in INLINE and not c.out:
            run.append(c)
            continue
        if run:
            yield run
            run = []
        yield [c]
    if run:
        yield run


def _belongs(part: list, node: Element, near: bool) -> bool:
    """Whether a part beside node stays: near the best container, or beside one of its ancestors."""
    first = part[0]
    if not isinstance(first, str) and first.out:
        return False
    if isinstance(first, str) or first.name in INLINE:
        size = sum(len(c.strip()) if isinstance(c, str) else c.size for c in part)
        linked = sum(0 if isinstance(c, str) else c.size if c.name == "a" else c.linked for c in part)
        return near and node.name not in MARKED and size > 0 and linked <= LINKS * size
    if _container(first) and node.points > 0 and first.points >= SHARE * node.points:
        return True
    if node.name in MARKED:
        return False
    return _reads(first) or near and first.holds and _container(first) and first.linked <= LINKS * first.size


def _chosen(elements: list[Element]) -> list:
    """What is kept of a scored tree, in page order."""
    best = max(elements, key=lambda e: e.points if _container(e) else -1.0)  # of equal ones the outermost
    kept, node = deque([best]), best
    while node.parent is not None and node.name != "body":
        before, after, seen = [], [], False
        for part in _runs(node.parent.children):
            if part[0] is node:
                seen = True
            elif _belongs(part, node, node is best):
                (after if seen else before).extend(part)
        kept.extendleft(reversed(before))
        kept.extend(after)
        if node.name in MARKED:
            break
        node = node.parent
    return list(kept)


def main_text(html: str | None) -> str:
    """The text of the article; blocks are joined by one space. Empty for a null or empty page."""
    if not html:
        return ""
    elements = _pruned(parse(html))
    _score(elements)
    return _text(_chosen(elements))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest, html = batch.drop_columns(["__html"]), batch.column("__html")
        for at in range(0, len(batch), 64):
            texts = [main_text(h) for h in html.slice(at, 64).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rest.slice(at, 64).columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*rest.schema.names, "text", "n_chars"])


def declared_language(html: Column) -> Column:
    """The language that a page's root element declares; empty if none."""
    return F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", 1))


def extracted(pages: DataFrame, **keep: Column) -> DataFrame:
    """page_id, url, columns of `keep`, text, n_chars of every row of pages (page_id, url, html; others are ignored).

    A null or empty page has an empty text; null ids and addresses and repeated
    rows are passed on as they are. A page of any length is read whole, in time
    in proportion to its length; an empty table gives no rows.
    """
    common.modest_batches(pages.sparkSession)
    own = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), *[c.alias(k) for k, c in keep.items()]]
    rows = pages.select(*own, F.col("html").cast("string").alias("__html"))
    schema = rows.drop("__html").select("*", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return rows.mapInArrow(_extract, schema)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extracted(common.table(spark, sf_dir, "pages"))
