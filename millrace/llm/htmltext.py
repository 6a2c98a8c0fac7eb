"""Main text of web pages by composite text density."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from .common import pick

#: Elements that never hold article text.
DROPPED = frozenset(
    "head title script style noscript template nav header footer aside button select option textarea input "
    "iframe object embed svg canvas audio video map dialog menu label".split()
)
#: Words in a class, an id or a role that mark a part beside the article, unless it holds most of the page's text.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside widget nav "
    "navbar navigation menu breadcrumb breadcrumbs header masthead footer comment comments reply replies disqus "
    "cookie cookies consent notice notices gdpr alert popup modal overlay share sharing social related recommended "
    "newsletter subscribe signup login pagination pager toolbar complementary contentinfo search".split()
)
#: Elements that end the block before them and begin one of their own.
BLOCKS = frozenset(
    "address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that only group others: around the densest part they have to be dense themselves.
CONTAINERS = frozenset("div section article center fieldset details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag ends if still open, and where the look for it stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
}
#: Elements that an end tag of an inner element never reaches beyond.
HOLDERS = frozenset("html body main article section div td th li blockquote nav aside header footer form table".split())
MARKS = re.compile(r"[a-z]+")
#: A part named by such a word alone (class="comments") is the article if its text is over so many times all other kept text.
NAMED = 9


class Node:
    __slots__ = ("tag", "parent", "content", "beside", "mark", "plain", "chars", "tags", "link_chars", "link_tags", "rate", "density", "total")

    def __init__(self, tag: str, parent: Node | None, beside: bool, mark: int = 0):
        self.tag, self.parent, self.beside, self.mark = tag, parent, beside, mark
        self.content: list[Node | str] = []
        self.plain = self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.rate = self.density = self.total = 0.0


class Tree(HTMLParser):
    """The page as nodes; a node's content holds its texts and children in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.now = Node("html", None, False)
        self.nodes = [self.now]

    def path(self) -> Iterator[Node]:
        node = self.now
        while node is not None:
            yield node
            node = node.parent

    def shut(self, tags, within) -> None:
        """End the nearest open element of tags, unless one of within lies between."""
        for node in self.path():
            if node.tag in tags and node.parent is not None:
                self.now = node.parent
                return
            if node.tag in within:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "html" or tag == "body" and any(n.tag == "body" for n in self.path()):
            return
        if tag == "body":
            self.now = self.nodes[0]
        if tag in BLOCKS:
            self.shut({"p"}, HOLDERS)
        if tag in CLOSES:
            self.shut(*CLOSES[tag])
        names = [w for k, v in attrs if k in ("class", "id", "role") and v for w in v.lower().split()]
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        mark = 0
        if tag not in ("body", "article", "main"):
            if not BESIDE.isdisjoint(names):
                mark = NAMED
            elif tag == "form" or any(not BESIDE.isdisjoint(MARKS.findall(w)) for w in names):
                mark = 1
        node = Node(tag, self.now, tag in DROPPED or hidden, mark)
        self.now.content.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_endtag(self, tag):
        within = () if tag in HOLDERS else HOLDERS
        self.shut({tag}, within)

    def handle_data(self, data):
        self.now.content.append(data)


def letters(node: Node) -> int:
    """Characters of the node's own texts, without white space."""
    return sum(len(t) - sum(map(t.count, " \n\t\r")) for t in node.content if isinstance(t, str))


def judge(nodes: list[Node]) -> None:
    """Decide which marked nodes are beside the article; the others are wrappers or hold it, and stay.

    At first all text below marks counts as cut. As long as one of the outermost marked nodes holds
    more text outside links than all that is kept, the largest such node is kept, and the marked
    nodes inside it are judged in turn. A node that is named as a part beside the article needs NAMED
    times as much. Once an article or main element has kept text, a named node outside of it is cut, and
    any other marked node there needs NAMED times as much.
    """
    for n in nodes[1:]:
        n.beside = n.beside or n.parent.beside
    for n in reversed(nodes):
        if not n.beside and n.tag != "a":
            n.plain += letters(n)
            if n.parent is not None:
                n.parent.plain += n.plain
    kept, in_article = 0, 0
    loose: list[tuple[int, int, Node]] = []  # outermost marked nodes, the largest first
    named: list[tuple[int, int, Node]] = []  # those that need NAMED times the kept text

    def keep(top: Node, inside: bool) -> None:
        """Count top's text outside marked nodes, and line those up."""
        nonlocal kept, in_article
        stack = [(top, inside)]
        while stack:
            node, inside = stack.pop()
            inside = inside or node.tag in ("article", "main")
            if node.beside or node.tag == "a":
                continue
            own = letters(node)
            kept += own
            in_article += own if inside else 0
            for x in node.content:
                if isinstance(x, str):
                    continue
                if not x.mark:
                    stack.append((x, inside))
                elif x.plain and not x.beside:
                    waiting.append((x, inside))

    waiting: list[tuple[Node, bool]] = []
    at = 0
    keep(nodes[0], False)
    while True:
        for x, inside in waiting[at:]:
            at += 1
            heapq.heappush(named if x.mark == NAMED or in_article and not inside else loose, (-x.plain, at, x))
        top = [h for h in (loose, named) if h]
        if not top:
            break
        heap = max(top, key=lambda h: -h[0][0] * (1 if h is loose else 1 / NAMED))
        share = NAMED if heap is named else 1
        size, number, node = heap[0]
        if -size <= share * kept:
            break
        heapq.heappop(heap)
        if in_article and not waiting[number - 1][1]:  # the page says where its article is
            if heap is loose:
                heapq.heappush(named, (size, number, node))
                continue
            if node.mark == NAMED:
                continue
        node.mark = 0
        keep(node, waiting[number - 1][1])
    for n in nodes[1:]:
        n.beside = n.beside or n.mark > 0 or n.parent.beside


def measure(nodes: list[Node]) -> None:
    """Characters, tags and densities of every node; parts beside the article count nothing.

    The rate is characters outside links per tag. Density is characters per tag, times the logarithm of how far characters and tags outweigh
    those of links. Nodes come after their parents in the list.
    """
    for n in reversed(nodes):
        if n.beside:
            continue
        n.chars += letters(n)
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.tags += n.tags + 1
            n.parent.link_chars += n.link_chars
            n.parent.link_tags += n.link_tags
    share = nodes[0].link_chars / max(1, nodes[0].chars)
    for n in nodes:
        if n.chars:
            plain = max(1, n.chars - n.link_chars)
            n.rate = (n.chars - n.link_chars) / max(1, n.tags)
            base = math.log(n.chars / plain * n.link_chars + share * n.chars + math.e)
            against = n.chars / max(1, n.link_chars) * max(1, n.tags) / max(1, n.link_tags)
            n.density = n.chars / max(1, n.tags) * math.log(max(against, 1) + 1) / max(1.0, base)
    for n in nodes[1:]:
        n.parent.total += n.density


def has_block(node: Node) -> bool:
    stack = [node]
    while stack:
        x = stack.pop()
        if x.tag in BLOCKS:
            return True
        stack += [c for c in x.content if not isinstance(c, str)]
    return False


def title_only(node: Node) -> bool:
    """All of the node's text stands in headings."""
    return all(x.tag in HEADINGS or isinstance(x, Node) and title_only(x) if not isinstance(x, str) else not x.strip()
               for x in node.content if isinstance(x, str) or not x.beside and x.chars)


def article_parts(node: Node, child: Node, threshold: float) -> list[Node | str]:
    """The node's content: child, and of its siblings what belongs to the article.

    Blocks and lines whose text is mostly links do not. A container belongs to it if its rate reaches the
    threshold or it holds the title alone; paragraphs, lists, tables and loose lines belong to it as they are.
    """
    runs: list[list[Node | str]] = [[]]  # a block, or texts and inline elements between blocks
    for x in node.content:
        if not isinstance(x, str) and (x is child or has_block(x)):
            runs += [[x], []]
        else:
            runs[-1].append(x)
    kept = []
    for run in runs:
        parts = [x for x in run if not isinstance(x, str) and not x.beside]
        own = sum(sum(map(str.isalnum, x)) for x in run if isinstance(x, str))
        plain = own + sum(x.chars - x.link_chars for x in parts)
        if child in parts:
            kept += run
        elif plain > sum(x.link_chars for x in parts):
            first = run[0]
            if isinstance(first, str) or first.tag not in CONTAINERS or first.rate >= threshold or title_only(first):
                kept += run
    return kept


def main_node(nodes: list[Node]) -> Node:
    """The page's root, its content narrowed to the article.

    The node with the largest sum of child densities holds the article or its largest part. The fewest characters
    outside links per tag on the path from it to the body are the threshold that containers around it have to reach to be
    parts of the article too, at every level; the logarithm in the density would favour large ones.
    """
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    best = max(nodes, key=lambda n: (n.total, n.density))
    path = [best]
    while path[-1].parent is not None and path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.rate for n in path)
    while best.parent is not None:
        best.parent.content = article_parts(best.parent, best, threshold)
        best = best.parent
    return best


def blocks(top: Node) -> list[str]:
    """The texts of top's blocks in page order, each with single spaces."""
    done, open_block = [], []

    def end():
        text = " ".join("".join(open_block).split())
        if text:
            done.append(text)
        open_block.clear()

    stack = [(top, iter(top.content))]
    while stack:
        node, rest = stack[-1]
        for x in rest:
            if isinstance(x, str):
                open_block.append(x)
            elif not x.beside:
                if x.tag in BLOCKS:
                    end()
                elif x.tag == "br":
                    open_block.append(" ")
                stack.append((x, iter(x.content)))
                break
        else:
            stack.pop()
            if node.tag in BLOCKS:
                end()
    end()
    return done


def main_text(html: str | None) -> str:
    """The article of a page: its blocks, joined by an empty line; empty for a null or empty page."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    judge(tree.nodes)
    measure(tree.nodes)
    return "\n\n".join(blocks(main_node(tree.nodes)))


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with the main text of each page and its length in code points.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are
    cut from the tree first; of what is left, the densest subtree is the article, with
    all text around it but blocks and lines that are mostly links. A form, or a part
    that only its class, id or role marks, stays where it holds most of the page's text outside links. A null or empty
    page has an empty text and length 0. One row per input row, repeated rows included; null ids
    stay. An empty table gives no rows. No shuffle.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = frame["html"].map(lambda x: main_text(x) if isinstance(x, str) else "")
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": text, "n_chars": text.map(len)})

    rows = pick(pages, "page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    rows = rows.withColumn("page_id", rows["page_id"].cast("string"))  # a null must not make ids floats
    made = rows.mapInPandas(run, "page_id string, url string, text string, n_chars bigint")
    return made.withColumn("page_id", made["page_id"].cast(kind))
