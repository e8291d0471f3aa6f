"""Main-text extraction by composite text density.

Each DOM node has characters C, tags T, linked characters LC and linked tags LT
of its subtree; tags that only mark up words are not counted.  Its density is
C / T, adjusted for links:

    (C / T) * log_b((C / LC') * (T / LT')),  b = ln(C / (C - LC)' * LC + LCb / Cb * C + e)

with primes for "at least 1" and LCb / Cb the link share of the body.  A node's
density sum adds the densities of its children.  Of the blocks that hold blocks,
the subtree with the largest sum is the main one; the threshold is the least
density on its path from the body.  Walking down that path from the body, what
lies beside the path belongs to the text too if it reaches the threshold and is
no small part, or stands in the same article.  Menus are left out by their
links.  Elements, classes, ids and roles are hints: a part that they name as
something beside the article weighs half in the choice, and is left out unless
it holds the chosen subtree or, where no article is marked up, most of the text.
"""

from __future__ import annotations

import html
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pieces

_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_MARK = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in "script style textarea title iframe".split()}
_SPLIT = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text of these is never text of the page.
RAW = frozenset("script style textarea title template iframe".split())
SKIP = RAW | frozenset("head button select option label audio video canvas".split())
#: Elements beside the article, unless they hold it.
ASIDE = frozenset("nav footer aside form menu fieldset".split())
BLOCK = frozenset(
    "html body article section main header footer aside nav div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr caption figure address details summary hr form fieldset hgroup center".split()
)
#: They mark up words within a block and are not counted as tags.
PHRASE = frozenset("b i em strong u s small big font span br wbr sup sub mark abbr cite q code kbd samp var time data bdi bdo ins del dfn tt strike acronym".split())
#: Blocks of text, which a class or id does not take out of an article.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr caption figcaption figure a".split()) | PHRASE
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role of what readers write.
READERS = frozenset("comment comments disqus respond reply replies".split())
CLOSES_P = BLOCK - {"html", "body", "thead", "tbody", "tfoot", "tr", "caption", "li", "dt", "dd"}
#: Words of a class, id or role that name a part beside the article; a token counts if its other words are of PLAIN.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer masthead topbar comment comments disqus respond reply replies share sharing social "
    "related recommended newsletter subscribe subscription signup login search pagination pager toolbar complementary contentinfo skip".split()
)
PLAIN = frozenset(
    " area bar block body box btn button buttons center col column container content element form global group header holder icons inner item items js left link links list "
    "main mobile module outer page panel post primary right row secondary section site slot small sub text title top bottom unit widget widgets wrap wrapper".split(" ")
)


class Node:
    """An element: its children are nodes and strings in page order."""

    __slots__ = ("c", "children", "density", "lc", "linked", "lt", "marked", "name", "parent", "readers", "skip", "sum", "t")

    def __init__(self, name: str, parent: Node | None, skip: bool):
        self.name, self.parent, self.skip, self.children = name, parent, skip, []
        self.c = self.t = self.lc = self.lt = 0
        self.linked = self.marked = self.readers = False
        self.density = self.sum = 0.0


def parse(page: str) -> Node:
    """A DOM of any input: unclosed elements end with their parents, stray end tags are passed over."""
    root = Node("html", None, False)
    here, at = root, 0
    open_names = {"html": 1}

    def shut(upto: Node):
        nonlocal here
        while here is not upto:
            open_names[here.name] -= 1
            here = here.parent

    while m := _TOKEN.search(page, at):
        name = m.group(2)
        name = name.lower() if name else ""
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        if not name:
            continue
        if m.group(1):
            if name == "p" and not open_names.get("p"):
                continue
            if open_names.get(name) and name != "html":
                node = here
                while node.name != name:
                    node = node.parent
                shut(node.parent)
            continue
        if name == "html":
            continue
        if name in CLOSES_P and open_names.get("p"):
            node = here
            while node.name not in ("p", "td", "th", "li", "div", "article", "section", "table", "html"):
                node = node.parent
            if node.name == "p":
                shut(node.parent)
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[name]
            node = here
            while node.name not in ends and node.name not in ("ul", "ol", "dl", "table", "select", "html") and not (name in ("td", "th") and node.name == "tr"):
                node = node.parent
            if node.name in ends:
                shut(node.parent)
        elif name == "body" and open_names.get("head"):
            node = here
            while node.name != "head":
                node = node.parent
            shut(node.parent)
        node = Node(name, here, here.skip or name in SKIP or _hidden(name, m.group(3)))
        inside = open_names.get("article") or open_names.get("main")
        named = not (inside and name in TEXT) and _beside(name, m.group(3))
        node.marked = name in ASIDE or bool(named) or (name == "header" and not inside)
        node.readers = named == "readers"
        here.children.append(node)
        if name not in VOID and not m.group(3).rstrip().endswith("/"):
            here = node
            open_names[name] = open_names.get(name, 0) + 1
            if name in _END:
                end = _END[name].search(page, at)
                at = end.start() if end else len(page)
    if at < len(page):
        here.children.append(page[at:])
    return root


def _hidden(name: str, attributes: str) -> bool:
    low = attributes.lower()
    # what stands in quotes is a value, not a name
    return "hidden" in low and name not in ("html", "body", "article", "main") and bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", _QUOTED.sub("''", low)))


def _beside(name: str, attributes: str) -> str:
    """What class, id and role say of a part beside the article: 'readers', 'beside' or nothing."""
    if not attributes or name in ("html", "body", "article", "main"):
        return ""
    low = attributes.lower()
    if "class" not in low and "id" not in low and "role" not in low:
        return ""
    found = {_names_beside(t) for m in _MARK.finditer(low) for t in (m.group(1) or m.group(2) or m.group(3) or "").split()}
    return "readers" if "readers" in found else "beside" if "beside" in found else ""


@lru_cache(65_536)
def _names_beside(token: str) -> str:
    """Whether a class, id or role names a part beside the article: sidebar-left and cookie-notice do, has-sidebar, ad-free and menu-open do not."""
    words = _SPLIT.split(token)
    if not (any(w in BESIDE for w in words) and all(w in BESIDE or w in PLAIN for w in words)):
        return ""
    return "readers" if any(w in READERS for w in words) else "beside"


def _measure(body: Node) -> list[Node]:
    """Fills c, t, lc and lt of ``body`` and the nodes below it, which are returned; skipped parts count as empty."""
    nodes = list(_nodes(body))
    for node in nodes:
        node.linked = node is not body and (node.parent.linked or node.name == "a")
    for node in reversed(nodes):
        n = sum(len(_SPACE.sub(" ", x).strip()) for x in node.children if isinstance(x, str))
        node.c += n
        node.lc += n if node.linked else 0
        if node is not body:
            up = node.parent
            up.c, up.t = up.c + node.c, up.t + node.t + (node.name not in PHRASE)
            up.lc, up.lt = up.lc + node.lc, up.lt + node.lt + (node.name == "a")
    return nodes


def _density(node: Node, share: float) -> float:
    if not node.c:
        return 0.0
    c, t, lc, lt = node.c, max(node.t, 1), node.lc, node.lt
    base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    ratio = c / max(lc, 1) * t / max(lt, 1)
    return c / t * max(math.log(max(ratio, 1e-9)) / max(math.log(max(base, 1 + 1e-9)), 1e-9), 0.0) if base > 1 + 1e-9 else c / t * max(math.log(max(ratio, 1e-9)), 0.0)


def _nodes(node: Node):
    """``node`` and those below it in page order, without skipped parts."""
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack += [x for x in reversed(node.children) if isinstance(x, Node) and not x.skip]


def _children(node: Node) -> list[Node]:
    return [x for x in node.children if isinstance(x, Node) and not x.skip]


def _menu(node: Node) -> bool:
    """A block whose text is links, three of them or more."""
    return node.lt >= 3 and 5 * node.lc >= 4 * node.c


def _choose(body: Node, nodes: list[Node]) -> Node:
    """Of the blocks that hold blocks the one with the largest density sum; parts beside the article weigh half, readers' parts count only if there is nothing else."""
    weight = {body: 1.0}
    for x in nodes:
        if x is not body:
            weight[x] = 0.0 if x.readers else weight[x.parent] * (0.5 if x.marked and weight[x.parent] == 1 else 1.0)
    best, most = body, (-1.0, -1.0)
    for x in nodes:
        if x.name in BLOCK and any(y.name in BLOCK for y in _children(x)):
            rank = (weight[x] * x.sum, x.sum if not weight[x] else 0.0)
            if rank > most:
                best, most = x, rank
    return best


def main_node(root: Node) -> Node | None:
    """The node that holds the main text; what does not belong to it is skipped from then on."""
    body = next((x for x in _nodes(root) if x.name == "body"), root)
    nodes = _measure(body)
    if not body.c:
        return None
    share = body.lc / body.c
    for x in nodes:
        x.density = _density(x, share)
    for x in nodes:
        x.sum = sum(y.density for y in _children(x))
    best = _choose(body, nodes)
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    path.reverse()
    least = min(x.density for x in path)
    scope, inside = None, False
    for x, below in zip(path, path[1:]):
        inside = inside or x.name in ("article", "main")
        kept = [y for y in _children(x) if y is below or _belongs(y, below, best, least, inside)]
        if len(kept) > 1 and scope is None:
            scope = x
        for y in _children(x):
            y.skip = y not in kept
    scope = scope or best
    on_path, stack = set(path), [scope]
    articles = _articles(scope, on_path)
    while stack:
        x = stack.pop()
        for y in _children(x):
            holds = y in on_path or (not articles and not y.readers and 2 * (y.c - y.lc) > scope.c - scope.lc)
            y.skip = not holds and (y.marked or (y.name in BLOCK and _menu(y)))
            if not y.skip:
                stack.append(y)
    return scope


def _articles(scope: Node, on_path: set[Node]) -> bool:
    """Is there an article with text outside the parts that are named as beside it?"""
    stack = [scope]
    while stack:
        x = stack.pop()
        if x.name in ("article", "main") and x.c:
            return True
        stack += [y for y in _children(x) if y in on_path or not y.marked]
    return False


def _belongs(x: Node, below: Node, best: Node, least: float, inside: bool) -> bool:
    """Does ``x``, beside the path that goes on with ``below``, belong to the text?"""
    if x.marked or not x.c or _menu(x):
        return False
    if inside or (x.density >= least and 5 * x.c >= best.c and 2 * x.lc < x.c):
        return True
    if x.name not in HEADINGS or x.lc:
        return False
    beside = [y for y in _children(x.parent) if y is below or y.c]
    return beside.index(below) - beside.index(x) == 1 and not any(y.name in ("h1", x.name) for y in _nodes(below))


def _blocks(node: Node) -> list[list[str]]:
    """The texts of each block below ``node``, in page order."""
    out: list[list[str]] = [[]]
    stack: list = [iter(node.children)]
    ends: list = [None]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            end = ends.pop()
            if end == " ":
                out[-1].append(end)
            elif end:
                out.append([])
        elif isinstance(child, str):
            out[-1].append(child)
        elif not child.skip:
            end = " " if child.name in ("br", "td", "th") else "block" if child.name in BLOCK else None
            if end == " ":
                out[-1].append(end)
            elif end:
                out.append([])
            stack.append(iter(child.children))
            ends.append(end)
    return out


def main_text(page: str | None) -> str:
    """The main text: blocks in page order, joined by a blank line; empty if there is none."""
    if not page:
        return ""
    node = main_node(parse(page))
    if node is None:
        return ""
    texts = (_SPACE.sub(" ", html.unescape("".join(parts))).strip() for parts in _blocks(node))
    return "\n\n".join(t for t in texts if t)


def _text_batches(batches):
    for whole in batches:
        for batch in pieces(whole):
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html).

    A null or empty page, and one without text, has an empty text; null ids and
    URLs and repeated rows are returned as they are.  Whole pages are read,
    however long or deep.  Of equal density sums the first in page order
    counts.  Columns besides the three, whatever their names, play no part; an
    empty table gives an empty result.
    """
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(_text_batches, "page_id long, url string, text string, n_chars long")
