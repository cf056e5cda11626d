"""Main text of web pages by composite text density of their nodes."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices

# Names of elements and attributes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset("address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open p ends where one of these begins.
CLOSES_P = BLOCKS - frozenset("caption option optgroup td th tr tbody thead tfoot html body legend summary".split())
#: An open element of the first kind ends where one of the others begins, unless one of the last kind is between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
}
#: Elements that never hold an article's text.
DROPPED = frozenset("head script style noscript template iframe object embed svg canvas audio video map nav aside footer form button select input textarea label fieldset dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
#: Words of class and id names that mark what surrounds an article.
MARKS = frozenset("ad ads advert adverts advertisement advertising adslot adsbygoogle breadcrumb breadcrumbs comments commentlist consent cookie cookies disqus gdpr masthead menu menus nav navbar navigation newsletter pager pagination paywall popup promo promoted sidebar sidebars signup sponsored subscribe toolbar".split())
#: Words that mark so as a whole name, or with words that only say where and how large a box is.
UNSURE = frozenset("banner banners comment footer header modal notice notices notification promotion recommended related replies reply respond responses share sharing skip social sponsor widget widgets".split())
#: Words that say where and how large a box is, or what kind of rows it has; a name of other words casts a doubt only.
PLACES = frozenset("area bar block body bottom box buttons col column container fixed global group holder inner item items left legal link links list main outer page panel primary reader right row secondary section site slot sticky thread top unit user wrap wrapper".split())
#: What a mark of the first kind may belong to; an article's own header or footer is not told by these.
OWNERS = frozenset("article blog content entry post story".split())
#: Elements that a doubtful word can mark, and those that no class or id marks.
CONTAINERS = frozenset("address center details div dl fieldset figure hgroup ol section table ul".split())
CONTROLS = frozenset("form button input select textarea".split())
KEPT = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2".split())
TITLES = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BETWEEN = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    dropped: bool = False
    named: bool = False  # by a word of its class or id only
    doubtful: bool = False  # a part of its class or id speaks against it
    parts: list = field(default_factory=list)  # texts and nodes, in order
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0

    def children(self) -> Iterator[Node]:
        return (x for x in self.parts if isinstance(x, Node))


def _marked(tag: str, raw: str, inside_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element and all it holds is no part of an article, by its name and attributes; whether only its class or id says so; whether they cast a doubt."""
    if tag in DROPPED or tag == "header" and not inside_article:
        return True, False, False
    if not raw or tag in KEPT:
        return False, False, False
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES:
        return True, False, False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True, False, False
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    whole = {x.lower() for x in names}
    if tag not in CONTAINERS:
        named = not MARKS.isdisjoint(whole)
        return named, named, False
    words = [{x for x in _BETWEEN.split(_CAMEL.sub(" ", name).lower()) if x and not x.isdigit()} for name in names]
    telling = [w for w in words if not w.isdisjoint(MARKS | UNSURE)]
    named = not whole.isdisjoint(MARKS | UNSURE) or any(w <= MARKS | UNSURE | PLACES | (frozenset() if w.isdisjoint(MARKS) else OWNERS) for w in telling)
    return named, named, not named and bool(telling)


def parse(page: str) -> Node:
    """The elements of a page, as browsers nest them: missing ends are added, stray ones are left out."""
    root = Node("html", None)
    now, at, size = root, 0, len(page)
    articles = 0

    def close(to: Node) -> None:
        nonlocal now, articles
        while now is not to:
            articles -= now.tag in ("article", "main")
            now = now.parent
        articles -= now.tag in ("article", "main")
        now = now.parent

    while at < size:
        m = _TAG.search(page, at)
        begin = m.start() if m else size
        if begin > at:
            now.parts.append(html.unescape(page[at:begin]))
        if not m:
            break
        at, name = m.end(), m[2]
        if not name:
            continue
        tag = name.lower()
        if m[1]:
            node = now
            while node is not root and node.tag != tag:
                if node.tag in ("td", "th", "table") and tag not in BLOCKS:
                    node = root
                    break
                node = node.parent
            if node is not root:
                close(node)
            continue
        if tag in ("html", "body"):
            if tag == "body" and now is root:
                node = Node(tag, now)
                now.parts.append(node)
                now = node
            continue
        if tag in BLOCKS and now.tag != "body":
            kinds, fence = ({"p"}, {"button", "table", "td", "th"}) if tag in CLOSES_P else (set(), set())
            for kinds, fence in ((kinds, fence), ENDS.get(tag, (set(), set()))):
                node, last = now, None
                while kinds and node is not root and node.tag not in fence:
                    if node.tag in kinds:
                        last = node
                    node = node.parent
                if last is not None:
                    close(last)
        node = Node(tag, now, *_marked(tag, m[3], articles > 0))
        now.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            node.dropped, node.named = True, False
        elif tag not in VOID and not m[3].rstrip().endswith("/") or tag in BLOCKS and tag != "hr":
            articles += tag in ("article", "main")
            now = node
    _keep_wrappers(root)
    return root


def _keep_wrappers(root: Node) -> None:
    """Elements that only a class or id marks stay if they hold a main element, the article element with the most text, or most of the page's characters outside links.

    What is dropped for another reason counts for nothing; a marked element within one that stays is judged alike.
    """
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        if node.dropped and not node.named:
            continue
        order.append((node, link))
        stack.extend((x, link or x.tag == "a") for x in node.children())
    if not any(node.named for node, _ in order):
        return
    plain: dict[int, int] = {}
    for node, link in reversed(order):
        n = 0 if link else sum(len("".join(x.split())) for x in node.parts if isinstance(x, str))
        plain[id(node)] = n + sum(plain.get(id(x), 0) for x in node.children())
    articles = [node for node, _ in order if node.tag == "article"]
    holds: set[int] = set()
    for node in [*(node for node, _ in order if node.tag == "main"), *([max(articles, key=lambda x: plain[id(x)])] if articles else [])]:
        while node is not None and id(node) not in holds:
            holds.add(id(node))
            node = node.parent
    for node, _ in order:
        if node.named and (id(node) in holds or 2 * plain[id(node)] > plain[id(root)]):
            node.dropped = False


def measure(root: Node) -> None:
    """Characters, tags and densities of every node that is not dropped.

    A node's density is its characters per tag, adjusted by a logarithm whose argument grows with the characters
    and tags that are not in links, and whose base grows with the share of link characters; total is the sum of
    its children's densities. A doubtful node is dropped if half of its text or more is in links or it has
    controls; else it stays but adds nothing to its parent's total.
    """
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        if node.dropped:
            continue
        order.append((node, link))
        for x in node.parts:
            if isinstance(x, Node):
                stack.append((x, link or x.tag == "a"))
            else:
                n = len("".join(x.split()))
                node.chars += n
                node.link_chars += n * link
    for node, link in reversed(order):
        for x in node.children():
            if not x.dropped:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a" or link)
        node.dropped = node.doubtful and (2 * node.link_chars >= node.chars or _controls(node))
    whole = next((x for x in root.children() if x.tag == "body"), root)
    share = whole.link_chars / max(1, whole.chars)
    for node, _ in reversed(order):
        if node.chars and not node.dropped:
            links, other, tags = max(1, node.link_chars), max(1, node.chars - node.link_chars), max(1, node.tags)
            base = math.log(node.chars / other * links + share * node.chars + math.e)  # above 1
            node.density = max(0.0, node.chars / tags * math.log(node.chars / links * tags / max(1, node.link_tags)) / math.log(base))
        node.total = sum(x.density for x in node.children() if not x.dropped and not x.doubtful)


def _controls(node: Node) -> bool:
    """Whether there is a form or a control among an element's children or theirs."""
    return any(x.tag in CONTROLS or any(y.tag in CONTROLS for y in x.children()) for x in node.children())


def select(root: Node) -> tuple[Node | None, float]:
    """The subtree of the article and the threshold: the least density on the path from it to the body.

    The node with the largest sum of its children's densities is the core; it grows to the outermost ancestor
    that holds another part as dense as the threshold, or of the same kind and not mainly links, or text or a
    heading of its own. Names of elements such as article or main have no say.
    """
    whole = next((x for x in root.children() if x.tag == "body"), root)
    best, stack = None, [whole]
    while stack:
        node = stack.pop()
        if node.chars and (best is None or (node.total, node.density) > (best.total, best.density)):
            best = node
        stack.extend([x for x in reversed(node.parts) if isinstance(x, Node) and not x.dropped and not x.doubtful])
    if best is None:
        return None, 0.0
    path = [best]
    while path[-1] is not whole:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    for k in range(len(path) - 1, 0, -1):
        others = [x for x in path[k].children() if x is not path[k - 1] and not x.dropped and not x.doubtful and x.chars]
        alike = any(x.density >= threshold or x.tag in HEADINGS or x.tag == path[k - 1].tag and 2 * x.link_chars < x.chars for x in others)
        if alike or any(isinstance(x, str) and x.strip() for x in path[k].parts):
            return path[k], threshold
    return best, threshold


def _menu(node: Node, threshold: float) -> bool:
    """A list of links within the article: links only, several of them, thinner than the threshold, and not under a heading, as sources are."""
    if node.tag not in ("ul", "ol", "div", "section", "table") or node.link_tags < 3 or node.link_chars < 0.8 * node.chars or node.density >= threshold:
        return False
    before = None
    for x in node.parent.parts:
        if x is node:
            break
        if isinstance(x, str):
            before = x if x.strip() else before
        elif not x.dropped:
            before = x
    return not (isinstance(before, Node) and before.tag in TITLES and before.chars)


def blocks(node: Node, threshold: float) -> list[str]:
    """The texts of a subtree's blocks in the page's order; a block ends where a block element begins or ends."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif x.dropped or x is not node and _menu(x, threshold):
            if x.tag in BLOCKS:
                flush()
        elif x.tag == "br":
            held.append(" ")
        else:
            if x.tag in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(x.parts))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    measure(root)
    node, threshold = select(root)
    return "\n".join(blocks(node, threshold)) if node is not None else ""


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row for each row of pages: its id, url, text (the article's blocks, one to a line) and n_chars (code points).

    Null, empty and unreadable pages and those without text have an empty text. White space inside a block is one
    space, character references are decoded, nothing is cut at any length. Repeated rows get equal results;
    other columns are not read.
    """
    kind, place = pages.schema[id_col].dataType.simpleString(), pages.schema[url].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "page"):
            texts = [main_text(x) for x in batch["page"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(page).alias("page"))
    return rows.mapInArrow(run, f"id {kind}, url {place}, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url)
