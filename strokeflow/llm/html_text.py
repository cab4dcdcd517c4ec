"""Main text of HTML pages by consensus paths of each host.

1. Each page's containers are scored by the text of the paragraphs in them. The best one is widened
   to the outermost article or main around it, or else to the lowest container with nearly all kept
   text and the headline. Its path of tags and classes, with digits left out, is the page's vote.
2. Spark counts the votes of each host; the path with most pages wins (then the higher score).
3. Each page is read again at its host's path. A page without text there falls back on its own best.

In a container, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out: by tag, or by a class, id or role that names them as a whole ("has-sidebar"
and "share-price" do not). What holds most of the page's paragraph text is not left out for its names,
nor as a form or header. Character references are decoded, white space in a block becomes one
space, and blocks are joined by newlines. Null, empty or text-free pages give ''. Pages without a
host vote together as host ''. Repeated rows give equal texts, a null page_id stays null, an empty
table gives an empty result; columns other than page_id, url and html are ignored. Time and memory
grow with a page's length, however deep its elements are nested.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strokeflow.llm.common import bounded_broadcast, stored
from strokeflow.llm.url_filter import url_host

#: Paths of up to this many hosts are sent to every executor; more are joined by a shuffle.
BROADCAST_HOSTS = 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?<![^\s/>\"'])([^\s=/>\"']++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_PARTS = re.compile(r"[a-z]+")
_STYLE_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What stands in these is no part of the page's text; those of NESTED may hold others of their own tag.
RAW = frozenset("script style noscript template iframe textarea title svg object select".split())
NESTED = frozenset("template svg object select".split())
_RAW_TAG = {t: re.compile(rf"<(/?){t}(?=[\s/>])([^>]*)>", re.I) for t in RAW}
#: A slash in front of ">" that is no part of a value without quotes.
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$|(?:^|\s)[^\s=]+/$")
CONTROLS = frozenset("form input button select textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CONTAINERS = frozenset("article body div main section td".split())
DROPPED = frozenset("nav footer aside form button dialog menu head input label option fieldset".split())
#: Words in a class, id or role that mark what does not belong to the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent"
    " gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar widget widgets related"
    " recommended share sharing social breadcrumb breadcrumbs menu nav navbar navigation masthead footer comment comments reply"
    " replies respond disqus discussion login search searchbox pagination pager toolbar copyright contentinfo complementary"
    " form dialog alertdialog".split()
)
#: Words that go with marks in one name: "site-footer", "share-buttons". Others ("has", "no", "price") unmark it.
NEUTRAL = frozenset(
    "site page main global primary secondary top bottom left right first second upper lower sticky fixed mobile desktop small large"
    " bar box row col column area zone slot unit container wrapper wrap holder panel group inner outer block section list item items"
    " button buttons link links icon icons title text header image img post posts entry article articles story stories wp js c l o u"
    " inline module component region template form count meta tools".split()
)
#: Marks that name an element whatever words follow.
PREFIXES = frozenset("sidebar newsletter breadcrumb breadcrumbs navbar advert advertisement disqus gdpr pagination comments".split())
#: Reader comments are often longer than the article; they stay only where nothing else has paragraphs.
DISCUSSION = frozenset("comment comments reply replies respond disqus discussion".split())
HEADERS = frozenset(("header", "banner"))
PARAGRAPHS = frozenset("p pre blockquote".split())
#: Share of the page's kept text that counts as nearly all.
NEARLY = 0.95
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An id is an anchor first: alone, these words name parts of articles as well.
ANCHORS = frozenset("discussion search login menu nav notice notices form share sharing related reply navigation subscription promotion copyright widget widgets".split())
LISTS = frozenset(("ul", "ol", "dl", "table"))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


class Node:
    __slots__ = (
        "tag", "parent", "children", "attrs", "step", "path_id", "score", "kept", "share", "links", "size", "controls", "heading", "article", "out", "block", "item"
    )

    def __init__(self, tag: str, parent: Node | None, attrs: dict[str, str]):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children: list[Node | str] = []
        self.score = self.kept = 0.0
        self.share = 0.0  # of the page's paragraph text
        self.links = self.size = 0  # characters of link text and of all text below
        self.controls = tag in CONTROLS  # or one below
        # The nearest of the elements around it, itself included, that end an open paragraph or item.
        self.block = self if tag in BLOCKS or not parent else parent.block
        self.item = self if tag in CLOSES or tag in LISTS or not parent else parent.item
        self.heading = tag in HEADINGS  # or one below
        self.article = bool(parent) and (parent.article or parent.tag in ("article", "main"))
        self.out: bool | None = None  # whether it or an element around it is dropped, once that is known
        classes = ".".join(sorted({re.sub(r"\d+", "", c) for c in attrs.get("class", "").lower().split()}))
        self.step = f"{tag}.{classes}" if classes else tag
        self.path_id = xxhash.xxh3_64_intdigest(self.step.encode("utf-8", "surrogatepass"), parent.path_id) if parent else 0

    @property
    def path(self) -> str:
        """The tags and classes from the top, with digits left out; ``path_id`` is its hash."""
        steps, up = [], self
        while up.parent:
            steps.append(up.step)
            up = up.parent
        return "/".join(reversed(steps))


def parse(html: str) -> Node:
    """A tree of the elements; open paragraphs, items and cells are closed as browsers do."""
    root = node = Node("", None, {})
    opened: Counter[str] = Counter()
    at, size, last = 0, len(html), html.rfind(">") + 1

    def up_to(target: Node) -> Node:
        """Closes the elements inside ``target``."""
        x = node
        while x is not target:
            opened[x.tag] -= 1
            x = x.parent
        return target

    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            node.children.append(html[at:])
            break
        if m.start() > at:
            node.children.append(html[at : m.start()])
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            continue
        tag = name.lower()
        if m.group(1) or m.group(4):
            if opened[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = up_to(up.parent)
            continue
        rest = m.group(3) or m.group(6) or ""
        if tag in RAW:
            node.controls = node.controls or tag in CONTROLS
            if not (tag == "svg" and _SELF_CLOSED.search(rest)):
                at = _raw_end(html, tag, at, last)
            continue
        if (tag in BLOCKS or tag in CLOSES) and opened["p"] > 0:
            node = up_to(node.block.parent if node.block.tag == "p" else node)
        if tag in CLOSES and any(opened[x] > 0 for x in CLOSES[tag]):
            node = up_to(_close(node, CLOSES[tag]))
        if tag in ("html", "body", "head") and not rest.strip() and opened[tag] > 0:
            continue
        if tag == "body":
            up = node
            while up.parent and up.tag != "html":
                up = up.parent
            node = up_to(up)
        child = Node(tag, node, {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest else {})
        if "hidden" in rest and re.search(r"(?:^|\s)hidden(?:\s|$|=)", rest):
            child.attrs.setdefault("hidden", "hidden")
        node.children.append(child)
        if tag not in VOID and not (rest.endswith("/") and _SELF_CLOSED.search(rest)):
            node = child
            opened[tag] += 1
    _weigh(root)
    return root


def _raw_end(html: str, tag: str, at: int, last: int) -> int:
    """Where an element of ``RAW`` that opened before ``at`` ends; ``last`` is behind the last ">"."""
    depth = 1
    for m in _RAW_TAG[tag].finditer(html, at, max(at, last)):
        if m.group(1):
            depth -= 1
        elif tag in NESTED and not (tag == "svg" and _SELF_CLOSED.search(m.group(2))):
            depth += 1
        if not depth:
            return m.end()
    return len(html)


def _weigh(root: Node):
    """Sets each element's share of the page's paragraph text, links left out, its text and link text and whether it has a heading or a control."""
    nodes = list(_elements(root))
    inside = {id(root): False}
    for x in nodes:
        own = sum(len(c.strip()) for c in x.children if isinstance(c, str))
        inside[id(x)] = x.tag != "a" and (x.tag in PARAGRAPHS or inside[id(x.parent)])
        if inside[id(x)]:
            x.share = float(own)
        x.size = own
        if x.tag == "a":
            x.links = own
    for x in reversed(nodes):
        x.parent.share += x.share
        x.parent.links += x.links
        x.parent.size += x.size
        x.parent.controls = x.parent.controls or x.controls
        x.parent.heading = x.parent.heading or x.heading
    total = root.share
    if total:
        root.share = 1.0
        for x in nodes:
            x.share /= total


def _close(node: Node, tags: tuple) -> Node:
    """The parent of the nearest open element among ``tags``, looking no further than its list or table."""
    up = node.item
    while up.parent and up.tag not in LISTS:
        if up.tag in tags:
            return up.parent
        up = up.parent.item
    return node


def _elements(node: Node):
    stack = [node]
    while stack:
        x = stack.pop()
        if x is not node:
            yield x
        stack.extend(c for c in reversed(x.children) if not isinstance(c, str))


def _marked(name: str, marks: frozenset, prefixes: frozenset) -> list[str]:
    words = _PARTS.findall(name)
    known = words and (words[0] in prefixes or (any(w in marks for w in words) and all(w in marks or w in MARKS or w in NEUTRAL for w in words)))
    return words if known else []


def _named(node: Node, marks: frozenset, prefixes: frozenset = frozenset()) -> bool:
    """Whether a class, id or role as a whole is one of the marks, alone or with neutral words.

    Headings and paragraphs carry ids as anchors only, and so may a section or what stands in an article: there an id that
    is an ordinary word counts if controls or mostly links are below.
    """
    a = node.attrs
    if any(_marked(x, marks, prefixes) for x in f"{a.get('class', '')} {a.get('role', '')}".lower().split()):
        return True
    if node.tag in HEADINGS or node.tag == "p":
        return False
    anchor = node.tag == "section" or node.article
    for x in a.get("id", "").lower().split():
        words = _marked(x, marks, prefixes)
        if words and (not anchor or not ANCHORS.issuperset(w for w in words if w in MARKS) or node.controls or 2 * node.links > node.size):
            return True
    return False


def dropped(node: Node) -> bool:
    """Whether an element does not belong to the article."""
    most = node.share > 0.5
    if node.tag in DROPPED:
        return not (most and node.tag == "form")
    if node.tag == "header":
        return not most and not (node.article and node.heading)
    a = node.attrs
    if not a or node.tag in ("body", "html"):
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or _STYLE_HIDDEN.search(a.get("style", "")):
        return True
    if node.share < 1.0 and _named(node, DISCUSSION):
        return True
    if most:
        return False
    return _named(node, MARKS, PREFIXES) or (_named(node, HEADERS) and not (node.article and node.heading))


def outside(node: Node) -> bool:
    """Whether an element or one around it is dropped."""
    above = []
    while node.out is None and node.parent:
        above.append(node)
        node = node.parent
    found = bool(node.out)
    for x in reversed(above):
        found = x.out = found or dropped(x)
    return found


def blocks(node: Node) -> list[tuple[Node, str]]:
    """(innermost block element, text) of the blocks below a node, in page order."""
    out: list[tuple[Node, str]] = []
    held: list[str] = []

    def flush(owner: Node):
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append((owner, text))
            held.clear()

    # (element, None) opens an element, (element, owner) closes it and goes on in owner.
    owner, stack = node, [(c, False) for c in reversed(node.children)]
    owners = [node]
    while stack:
        x, closing = stack.pop()
        if isinstance(x, str):
            held.append(x)
        elif closing:
            flush(owners.pop())
        elif x.tag == "br" or x.tag in ("td", "th"):
            held.append(" ")
            stack.extend((c, False) for c in reversed(x.children))
        elif not outside(x):
            if x.tag in BLOCKS:
                flush(owners[-1])
                owners.append(x)
                stack.append((x, True))
            stack.extend((c, False) for c in reversed(x.children))
        else:
            held.append(" ")
    flush(owner)
    return out


def best_container(root: Node) -> tuple[Node, float]:
    """The container with the most paragraph text near its top, widened to the whole article, and its score.

    A text counts for the nearest container, by halves for the three around that.
    """
    own: dict[int, list[float]] = {}
    headline = None
    for owner, text in blocks(root):
        value = max(0.0, len(text) - 2.0 * owner.links) if owner.tag else float(len(text))
        if owner.tag in ("h1", "h2") and (headline is None or (owner.tag, headline.tag) == ("h1", "h2")):
            headline = owner
        own.setdefault(id(owner), [0.0] * 4)[0] += value
        owner.kept += value
    best, top = root, 0.0
    for x in [*reversed(list(_elements(root))), root]:
        held = own.pop(id(x), None)
        if held and (x.tag in CONTAINERS or x is root):
            x.score = sum(v / 2**i for i, v in enumerate(held))
            weighted = x.score * (1.5 if x.tag in ("article", "main") else 1.0)
            if weighted > 0 and weighted >= top:
                best, top = x, weighted
            held = [0.0, *held[:3]]
        if x is not root:
            x.parent.kept += x.kept
            if held:
                up = own.setdefault(id(x.parent), [0.0] * 4)
                for i, v in enumerate(held):
                    up[i] += v
    return _widened(best, headline, root.kept), top


def _widened(best: Node, headline: Node | None, total: float) -> Node:
    above = []
    up = best
    while up is not None:
        above.append(up)
        up = up.parent
    for x in reversed(above):
        if x.tag in ("article", "main"):
            return x
    around: set[int] = set()
    up = headline
    while up is not None:
        around.add(id(up))
        up = up.parent
    for x in above:
        if (x.tag in CONTAINERS or not x.tag) and x.kept >= NEARLY * total and (headline is None or id(x) in around):
            return x
    return above[-1]


def vote(html: str | None) -> tuple[str, int, float]:
    """Path, its hash and score of a page's best container."""
    best, score = best_container(parse(html or ""))
    return best.path, _signed(best.path_id), score


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def main_text(html: str | None, path_id: int | None) -> str:
    """Text of the page at the path with this hash, or in its own best container."""
    if not html:
        return ""
    root = parse(html)
    found: list[Node] = []
    if path_id is not None:
        if path_id == 0:  # the path of the page itself
            found = [root]
        inside: set[int] = set()
        for x in _elements(root):
            if id(x.parent) in inside:
                inside.add(id(x))
            elif _signed(x.path_id) == path_id and not outside(x):
                found.append(x)
                inside.add(id(x))
    lines = [t for x in found for _, t in blocks(x)]
    if not lines:
        lines = [t for _, t in blocks(best_container(root)[0])]
    return "\n".join(lines)


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, path_id): the path that most pages of the host vote for."""

    def run(parts):
        for part in parts:
            votes = [vote(h.as_py()) for h in part.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([v[0] for v in votes], pa.string()), pa.array([v[1] for v in votes], pa.int64()),
                    pa.array([v[2] for v in votes], pa.float64()),
                ],
                ["host", "path", "path_id", "score"],
            )

    votes = pages.select(url_host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, path_id long, score double")
    counted = votes.where("score > 0").groupBy("host", "path_id").agg(
        F.count("*").alias("n"), F.sum("score").alias("score"), F.min("path").alias("path")
    )
    best = F.max(F.struct("n", F.round("score", 3).alias("score"), "path", "path_id")).alias("x")
    return counted.groupBy("host").agg(best).select("host", "x.path", "x.path_id")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the path used, for each page."""
    paths = stored(host_paths(pages), "host-paths")

    def run(parts):
        for part in parts:
            text = [main_text(h.as_py(), p.as_py()) for h, p in zip(part.column(2), part.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), part.column(3)],
                ["page_id", "url", "text", "n_chars", "path"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", url_host(F.col("url")).alias("host"))
    return (
        rows.join(bounded_broadcast(paths, BROADCAST_HOSTS), "host", "left").select("page_id", "url", "html", "path", "path_id")
        .mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")
    )
