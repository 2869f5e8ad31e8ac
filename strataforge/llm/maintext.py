"""Operator 9: main text of web pages by composite text density."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.llm.arrow_text import rows_per_batch

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # a comment, to the end if it isn't closed
    r"|</([a-zA-Z][^\s/>]*)[^>]*>?"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
#: Elements that an inline element's end tag does not reach beyond.
BARRIERS = ("article", "main", "body", "td", "th", "table")
SCOPE = frozenset("table td th caption html body article section div ul ol dl button object".split())
DROPPED = frozenset(
    "head script style noscript template svg math canvas iframe object embed video audio form input button select textarea nav aside footer menu dialog title link meta base datalist".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs"
    " footer header masthead sidebar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription share sharing social related"
    " comment comments respond disqus login signup search searchform pagination pager skip toolbar widget widgets".split()
)
#: Words in the class of an article element that is not the page's article, and class names of single paragraphs and headings.
OTHER_ARTICLES = frozenset("comment comments reply replies teaser card related ad advert sponsored promo".split())
DROPPED_LINES = frozenset(
    "ad ads advert advertisement sponsored promo cookie cookies consent notice share sharing newsletter subscribe related breadcrumb breadcrumbs pagination pager comment comments footer".split()
)
#: Words that tell enough where everything on a page has a dropped name.
CERTAIN_WORDS = frozenset("comment comments respond disqus footer nav navbar navigation breadcrumb breadcrumbs cookie cookies".split())
PROSE = frozenset("p pre blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold parts of a page; the other blocks are parts of a text.
CONTAINERS = frozenset("html body div section article main center table tbody tr td th details fieldset form header aside footer nav dialog dir hgroup".split())
#: Share of the densities of a node's innermost blocks that its child must have to be taken for it, and that a neighbour of the chosen part must have.
MOST, SOME = 0.6, 0.1
KEPT_CONTAINERS = frozenset("html body article main".split())


class Node:
    __slots__ = ("tag", "attrs", "parts", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total", "mass", "titled", "dropped")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[Node | str] = []
        self.dropped = False


class _Open:
    """The open elements, with the positions of each name, so that closing one never walks the others."""

    def __init__(self, root: Node) -> None:
        self.stack, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: Iterable[str]) -> int:
        """Position of the innermost open element of these names; 0 if there is none."""
        return max((own[-1] for t in tags if (own := self.at.get(t))), default=0)

    def cut(self, k: int) -> None:
        for node in self.stack[k:]:
            self.at[node.tag].pop()
        del self.stack[k:]

    def close(self, tags: tuple[str, ...]) -> None:
        """Ends open elements of these names up to the nearest container."""
        while (k := self.last(tags)) and k > self.last(t for t in SCOPE if t not in tags):
            self.cut(k)
            if tags == ("p",) or self.stack[-1].tag not in tags:
                return

    def end(self, tag: str) -> None:
        """An end tag: of nothing that is open, or of an inline element beyond a container, it is stray."""
        k = self.last((tag,))
        if k and (tag in BLOCK or k > self.last(t for t in BARRIERS if t != tag)):
            self.cut(k)


def parse(page: str) -> Node:
    """A tree of elements and texts. Unclosed and stray tags are mended as browsers roughly do, in time linear in the page."""
    root = Node("html")
    opened, at, size = _Open(root), 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            opened.stack[-1].parts.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if tag == "html" and len(opened.stack) == 1:
                root.attrs = m[3]
                continue
            if tag in CLOSES_P:
                opened.close(("p",))
            if tag in SIBLINGS:
                opened.close(SIBLINGS[tag])
            node = Node(tag, m[3] or "", opened.stack[-1])
            opened.stack[-1].parts.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            elif tag not in VOID and not (m[3] or "").endswith("/"):
                opened.push(node)
        elif m[1]:
            opened.end(m[1].lower())
    return root


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _walk(root: Node):
    """Nodes before their descendants, without recursion."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(x for x in reversed(node.parts) if not isinstance(x, str))


def _words(node: Node) -> set[str]:
    a = _attributes(node.attrs)
    return set(re.findall(r"[a-z]+", f"{a.get('class', '')} {a.get('id', '')}".lower()))


def _prose(order: list[Node]) -> dict[int, int]:
    """Characters in paragraphs below each node, without dropped nodes."""
    chars, prose = {}, {}
    for node in reversed(order):
        if node.dropped:
            chars[id(node)] = prose[id(node)] = 0
            continue
        chars[id(node)] = sum(len(x) if isinstance(x, str) else chars[id(x)] for x in node.parts)
        prose[id(node)] = chars[id(node)] if node.tag in PROSE else sum(prose[id(x)] for x in node.parts if not isinstance(x, str))
    return prose


def _prune(order: list[Node], words: frozenset[str] = DROPPED_WORDS) -> None:
    """Marks menus, page headers, footers, adverts and the like by element, role, class and id.

    A node with the page's article or main element is never marked. Nor is a form or a node with a telling
    class that has the first heading and most of the paragraphs that are left: it is the page's frame.
    With fewer ``words`` than all, forms are kept.
    """
    holds = set()  # nodes with an article, a main part or a heading of first rank below
    headed = set()
    inner = set()  # nodes in an article or a main part
    for node in order:
        if node.parent is not None and (node.parent.tag in ("article", "main") or id(node.parent) in inner):
            inner.add(id(node))
        node.dropped = node.tag == "article" and bool(node.attrs) and node.parent is not None and bool(_words(node) & OTHER_ARTICLES)
        if node.tag in ("article", "main", "h1") and not node.dropped:
            up = node.parent
            where = headed if node.tag == "h1" else holds
            while up is not None and id(up) not in where:
                where.add(id(up))
                up = up.parent
    frames = []
    for node in order:
        if node.tag in KEPT_CONTAINERS:
            continue
        own_title = id(node) in headed and id(node) in inner
        if node.tag in DROPPED:
            node.dropped = id(node) not in holds and (node.tag != "form" or words is DROPPED_WORDS)
        elif node.tag == "header":
            node.dropped = id(node) not in holds and not own_title
        elif node.attrs:
            a = _attributes(node.attrs)
            style = a.get("style", "").replace(" ", "").lower()
            if node.tag in ("h1", "h2", "h3", "p"):
                bad = node.tag != "h1" and bool(DROPPED_LINES & set(a.get("class", "").lower().split()))
            else:
                bad = bool(_words(node) & words) or a.get("role", "").lower() in DROPPED_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
            node.dropped = bad and id(node) not in holds and not own_title
        if node.dropped and id(node) in headed and (node.tag == "form" or node.tag not in DROPPED and node.tag != "header"):
            node.dropped = False
            frames.append(node)
    if frames:
        prose = _prose(order)
        for node in frames:
            node.dropped = prose[id(node)] * 2 <= prose[id(order[0])]


def _measure(root: Node, order: list[Node]) -> Node:
    """Composite text density of every node that isn't dropped, and the sums over children; gives the body."""
    body = next((n for n in order if n.tag == "body" and not n.dropped), root)
    live = []
    todo = [root]
    while todo:
        node = todo.pop()
        live.append(node)
        todo.extend(x for x in node.parts if not isinstance(x, str) and not x.dropped)
    for node in reversed(live):  # children come after their parents in live
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for x in node.parts:
            if isinstance(x, str):
                node.chars += len("".join(x.split()))
            elif not x.dropped:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in live:
        node.density = _density(node, share)
    for node in reversed(live):
        below = [x for x in node.parts if not isinstance(x, str) and not x.dropped]
        node.total = sum(x.density for x in below)
        blocks = [x for x in below if x.tag in BLOCK] if node.tag not in PROSE and node.tag not in HEADINGS else []
        node.mass = sum(x.mass for x in blocks) if blocks else node.density
        node.titled = node.tag == "h1" or any(x.titled for x in below)
    return body


def _density(node: Node, share: float) -> float:
    """Characters per tag, lowered as links take more of the node's characters and tags.

    The factor is a logarithm of (C / LC) (T / LT) to the base
    ln(C / nonLC * LC + share * C + e); a zero divisor counts as 1. Where the page has no
    link text the base would be 1: then it is characters per tag alone.
    """
    if not node.chars:
        return 0.0
    plain = node.chars / max(node.tags, 1)
    base = math.log(node.chars / max(node.chars - node.link_chars, 1) * node.link_chars + share * node.chars + math.e)
    if base <= 1.0 + 1e-9:
        return plain
    weight = node.chars / max(node.link_chars, 1) * max(node.tags, 1) / max(node.link_tags, 1)
    return plain * math.log(max(weight, 1.0)) / math.log(base)


def _selected(body: Node) -> list[Node | str]:
    """The nodes that make the main text.

    The node with the largest sum of child densities is sought (the first in
    page order of equal ones), and the path to it is followed from the body. An
    element on it is left for its child while that child has ``MOST`` of
    the densities of its innermost blocks and the page's first heading is not left behind; an article on the path is
    followed into in any case, and never left. Where the path is left, that
    element is the main part. The least density on the whole path is the threshold: beside the path, containers
    stay only if their density reaches it and they have ``SOME`` of the densities. Within the
    part, blocks of links under the threshold are menus.
    """
    live = _live(body)
    best = max(live, key=lambda n: n.total)
    if best.total == 0.0:
        best = max(live, key=lambda n: n.density)
    path, node = [best], best
    while node is not body and node.parent is not None:
        node = node.parent
        path.append(node)
    path.reverse()
    threshold = min(n.density for n in path)
    last = max((k for k, n in enumerate(path) if n.tag == "article"), default=-1)
    if last < 0:
        main = max((k for k, n in enumerate(path) if n.tag == "main"), default=0)
        last = main
        while last + 1 < len(path):
            here, child = path[last], path[last + 1]
            if child.tag not in CONTAINERS or here.titled and not child.titled or child.mass < MOST * here.mass:
                break
            last += 1
    part = path[last]
    on_path = path[last + 1] if last + 1 < len(path) else None
    _drop_menus(part, threshold)
    if part.tag == "article":
        return [part]
    return [x for x in part.parts if isinstance(x, str) or x is on_path or not x.dropped and _belongs(x, part, threshold)]


def _live(root: Node) -> list[Node]:
    """Nodes that are not dropped, in page order."""
    live, todo = [], [root]
    while todo:
        node = todo.pop()
        live.append(node)
        todo.extend(x for x in reversed(node.parts) if not isinstance(x, str) and not x.dropped)
    return live


def _belongs(x: Node, part: Node, threshold: float) -> bool:
    if x.tag in CONTAINERS:
        return x.tag != "article" and x.density >= threshold and x.mass >= SOME * part.mass and x.link_chars * 2 <= x.chars
    return x.tag in PROSE or x.tag in HEADINGS or x.link_chars * 2 <= x.chars


def _drop_menus(part: Node, threshold: float) -> None:
    """Marks lists and containers below ``part`` that are links almost alone and less dense than the threshold."""
    for node in _live(part):
        if node is not part and node.tag in BLOCK and node.tag not in PROSE and node.tag not in HEADINGS and node.tag != "li":
            node.dropped = node.link_tags >= 3 and node.link_chars * 5 > node.chars * 4 and node.density < threshold


def _blocks(chosen: list[Node | str]) -> str:
    lines, line = [], []

    def end() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            lines.append(text)

    todo: list = [(x, False) for x in reversed(chosen)]
    while todo:
        x, closing = todo.pop()
        if isinstance(x, str):
            line.append(x)
        elif closing:
            end()
        elif not x.dropped:
            if x.tag in BLOCK:
                end()
                todo.append((x, True))
            todo.extend((y, False) for y in reversed(x.parts))
    end()
    return "\n".join(lines)


def main_text(page: str | None) -> str:
    """The main text of one page; empty for null and for pages without text."""
    if not page:
        return ""
    root = parse(page)
    order = list(_walk(root))
    _prune(order)
    body = _measure(root, order)
    if not body.chars:  # all that there is goes by a name that tells of something else
        _prune(order, CERTAIN_WORDS)
        body = _measure(root, order)
    return _blocks(_selected(body)) if body.chars else ""


def extract(spark, page: Column) -> Column:
    rows_per_batch(spark, 500)

    @F.arrow_udf("string")
    def text(x: pa.Array) -> pa.Array:
        return pa.array((main_text(p.as_py()) for p in x), pa.string())

    return text(page)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages``, in one pass without a shuffle.

    Null and empty pages give an empty text and n_chars 0, as do empty tables no rows; repeated rows and
    ids, nulls in the id and the url are kept as they are; a page is taken whole, however long;
    extra columns, whatever their names, are ignored.
    """
    told = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extract(pages.sparkSession, F.col(html_col)).alias("text"))
    return told.withColumn("n_chars", F.char_length("text").cast("bigint"))
