"""HTML extraction by composite text density.

A page becomes a tree by a forgiving tokenizer (implied ends of paragraphs, list items, cells and options; void
elements; unclosed tags end with their parent). Every node has its characters, link characters, tags and link tags;
its density is characters per tag, adjusted by a logarithm that falls as links outweigh text. A node's sum is that
of its children's densities. The path from the node of maximum sum to body gives two thresholds:

* its least density: every node that reaches it, and isn't mostly links, marks the node of maximum sum below it (or
  itself) as main text;
* half the density of the node of maximum sum: the ancestors that reach it, or add at most a fifth to the text, are
  main text as a whole, with the headings and short blocks that stand beside the dense ones, up to the first that
  adds mostly links. So are those up to an article or main element.

Menus, footers, sidebars, notices, adverts, scripts and reader comments, told by tag, role or a class or id whose
words all say so, count no characters and give no text; a header does so outside an article. A form, or what only a class
or id tells, stays if it holds an article or main element or most of the page's text; reader comments stay only
where there is nothing else.

Defined cases: null or empty html and pages without text give an empty text; text outside any element belongs to
body; broken markup never raises; of equal sums the outermost and first node counts; rows that repeat a page are each
extracted; whole pages are read, however long, in time proportional to their length; an empty table gives an
empty table; other columns pass through in `rest` under their own names.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import per_text, table, unpacked

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
DROPPED = set("head script style template noscript iframe svg canvas audio video object embed nav footer aside form button select input textarea dialog menu label fieldset title search annotation annotation-xml".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
DROPPED_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu submenu "
    "breadcrumb breadcrumbs sidebar rail footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login comment comments disqus respond replies reply share sharing social related recommended "
    "recommendations pagination pager widget widgets skip".split()
)
CLOSES_P = BLOCK - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend", "summary"}
#: An opening tag ends an open one of these, unless one of the second set lies between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
#: Words that may stand beside a dropped word in a class or id: cookie-banner and related-posts go, social-history stays.
BESIDE = set("area bar block bottom box button buttons container content footer form header icons inner item items left link links list main outer panel post posts right section site slot top unit wrap wrapper".split())
#: Headings and paragraphs stay whatever their class; by id, which headings' texts often make, only containers go.
TEXTS = set("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
CONTAINERS = set("div section ul ol dl details figure table center".split())
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


#: What tells reader comments.
COMMENT_WORDS = {"comment", "comments", "disqus", "respond", "replies", "reply"}
#: Why a node is left out: its tag or role says so, its class, id or form does, or it is told to be reader comments.
HARD, SOFT, COMMENTS = 1, 2, 3


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "in_article", "chars", "link_chars", "tags", "link_tags", "density", "total", "densest", "marked")

    def __init__(self, tag: str, parent: Node | None, dropped: int = 0):
        self.tag, self.parent, self.parts, self.dropped = tag, parent, [], dropped
        self.in_article = parent is not None and (parent.in_article or parent.tag in ("article", "main"))
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.densest, self.marked = self, False


def names_chrome(token: str) -> bool:
    words = {w.lower() for w in WORDS.findall(token)}
    return not words.isdisjoint(DROPPED_WORDS) and words <= DROPPED_WORDS | BESIDE


def is_dropped(tag: str, attributes: str, in_article: bool) -> int:
    """By tag or role, or by a class or id that names nothing but chrome; no id of a section inside an article does."""
    if tag == "form":
        return SOFT
    if tag in DROPPED or (tag == "header" and not in_article):
        return HARD
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    for m in ATTRIBUTE.finditer(attributes):
        value, kind = m[2] or m[3] or m[4] or "", m[1].lower()
        if kind == "role":
            if value.strip().lower() in DROPPED_ROLES:
                return HARD
        elif tag not in TEXTS and (kind == "class" or tag in CONTAINERS and not (in_article and tag == "section")):
            for token in value.split():
                if names_chrome(token):
                    return SOFT if COMMENT_WORDS.isdisjoint(w.lower() for w in WORDS.findall(token)) else COMMENTS
    return 0


def parse(page: str) -> Node:
    root = Node("body", None)
    stack, at, open_tags = [root], 0, Counter()

    def close(depth: int) -> None:
        while len(stack) > depth:
            open_tags[stack.pop().tag] -= 1

    while True:
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            stack[-1].parts.append(text)
        if m is None:
            return root
        at = m.end()
        if m[1]:
            stack[-1].parts.append(html.escape(m[1]))
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:  # an end tag
            for depth in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                if stack[depth].tag == tag:
                    close(depth)
                    break
                if tag not in BLOCK and stack[depth].tag in BLOCK:
                    break  # an inline end doesn't reach out of its block
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and open_tags["p"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag in BLOCK:
                    break
        if tag in IMPLIED:
            ends, bounds = IMPLIED[tag]
            lowest = 0
            for depth in range(len(stack) - 1, 0, -1) if any(open_tags[x] for x in ends) else ():
                if stack[depth].tag in bounds:
                    break
                if stack[depth].tag in ends:
                    lowest = depth
            if lowest:
                close(lowest)
        node = Node(tag, stack[-1])
        node.dropped = is_dropped(tag, m[4], node.in_article)
        stack[-1].parts.append(node)
        if tag in VOID or m[4].endswith("/") and tag in ("svg", "math", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            node.dropped = HARD
            at = end.end() if end else len(page)
            continue
        stack.append(node)
        open_tags[tag] += 1


def in_order(root: Node, dropped: bool = False) -> list[Node]:
    """The nodes below a node, parents first and in page order; with or without those that are left out."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in reversed(node.parts) if isinstance(x, Node) and (dropped or not x.dropped)]
    return order


def text_size(part: str) -> int:
    return len(" ".join(html.unescape(part).split()))


def free(root: Node) -> Node:
    """Keep what only a class, an id or a form would leave out, if the page is hardly anything without it."""
    size: dict[int, int] = {}
    articles: dict[int, bool] = {}
    order = [x for x in in_order(root, True)]
    for node in order:
        if node.parent is not None and node.parent.dropped == HARD:
            node.dropped = HARD
    for node in reversed(order):
        below = [x for x in node.parts if isinstance(x, Node) and x.dropped != HARD]
        size[id(node)] = sum(size[id(x)] for x in below) + sum(text_size(x) for x in node.parts if isinstance(x, str))
        articles[id(node)] = node.tag in ("article", "main") or any(articles[id(x)] and x.dropped != COMMENTS for x in below)
    whole = size[id(root)]
    for node in order:
        if node.dropped == SOFT and (articles[id(node)] or 2 * size[id(node)] > whole and not articles[id(root)]):
            node.dropped = 0
        elif node.dropped == COMMENTS and size[id(node)] == whole:
            node.dropped = 0
    return root


def measure(root: Node) -> list[Node]:
    """Fill in the figures of every node that isn't left out; these nodes, parents first."""
    order = in_order(root)
    for node in reversed(order):
        for x in node.parts:
            if isinstance(x, Node):
                if not x.dropped:
                    node.chars += x.chars
                    node.link_chars += x.link_chars
                    node.tags += x.tags + 1
                    node.link_tags += x.link_tags + (x.tag == "a")
            else:
                node.chars += text_size(x)
        if node.tag == "a":
            node.link_chars = node.chars
    share = root.link_chars / max(1, root.chars)
    for node in order:
        if node.chars:
            plain = max(1, node.chars - node.link_chars)
            base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
            adjust = math.log(node.chars / max(1, node.link_chars) * (max(1, node.tags) / max(1, node.link_tags)) + 1.0) / max(1.0, math.log(base + 1.0))
            node.density = node.chars / max(1, node.tags) * adjust
    for node in order:
        if node.parent is not None:
            node.parent.total += node.density
    for node in reversed(order):
        if node.parent is not None and node.densest.total > max(node.parent.total, 0.0 if node.parent.densest is node.parent else node.parent.densest.total):
            node.parent.densest = node.densest
    return order


def select(order: list[Node]) -> None:
    """Mark the nodes that are main text as a whole."""
    root = order[0]
    best = max(order, key=lambda n: n.total)  # of equal ones the first, so the outermost
    if best.total <= 0:
        root.marked = True
        return
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    least = min(n.density for n in path)
    for node in order:
        if node.density >= least and node is not root and 2 * node.link_chars <= node.chars:
            node.densest.marked = True
    whole = best
    while whole.parent is not None and (whole.in_article or belongs(whole.parent, whole, best)):
        whole = whole.parent
    whole.marked = True


def belongs(parent: Node, node: Node, best: Node) -> bool:
    """Whether what the parent adds to a node is main text too: not mostly links, and as dense or little."""
    more, links = parent.chars - node.chars, parent.link_chars - node.link_chars
    return 2 * links <= more and (2 * parent.density >= best.density or 5 * more <= node.chars)


def render(root: Node) -> str:
    """Texts of the blocks of the marked nodes, in page order."""
    blocks, now = [], []

    def end() -> None:
        if text := " ".join(html.unescape("".join(now)).split()):
            blocks.append(text)
        now.clear()

    todo: list = [(root, root.marked)]
    while todo:
        x, inside = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            if inside:
                now.append(x)
        elif not x.dropped:
            if x.tag == "br":
                now.append(" ")
                continue
            if x.tag in BLOCK:
                end()
                todo.append((None, inside))
            todo += [(part, inside or isinstance(part, Node) and part.marked) for part in reversed(x.parts)]
    end()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = free(parse(page))
    select(measure(root))
    return render(root)


def extract(pages: DataFrame, html_col: str = "html", carry=None) -> DataFrame:
    """Every row of `pages` as struct `rest`, with text and n_chars."""

    def work():
        def each(texts):
            found = [main_text(None if x is None else x.decode()) for x in texts]
            return [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]

        return each

    return per_text(pages, html_col, carry, work, "text string; n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return unpacked(found, ["page_id", "url"], "text", "n_chars")
