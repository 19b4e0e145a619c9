"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, less with
each level. A container's points are discounted by the share of its text that
lies in links. The best container and those of its siblings that also read like
text are kept; where it lies in an article, the article is kept.

Menus, headers, footers, sidebars, notices, adverts, forms, comments of readers,
scripts and styles are left out before the scoring. What is kept is cut into
blocks: character references are decoded, white space inside a block becomes one
space, blocks are joined in page order by two line breaks.

Markup may be broken: paragraphs and list items end where the next one starts,
end tags without a start are ignored, and whatever is open at the end is closed.
A null page has an empty text, as has a page that holds none.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody "
    "tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends these if they are open, up to the given bounds.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
LEFT_OUT = frozenset(
    "head script style noscript template nav footer aside form button input select textarea iframe object "
    "embed svg canvas audio video dialog menu title".split()
)
#: Words of a class, id or role that mark what is no part of an article.
FOREIGN = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside rail "
    "footer masthead topbar toolbar cookie cookies consent gdpr notice notification alert popup modal overlay "
    "newsletter subscribe subscription signup login social share sharing comment comments disqus reply replies "
    "respond discussion related recommended recommendation recommendations widget contentinfo complementary "
    "search form hidden".split()
)
OUTER_FOREIGN = frozenset({"header", "banner"})
CLASS_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
PARAGRAPHS = frozenset("p pre td blockquote li dd figcaption".split())
CONTAINERS = {"article": 30.0, "main": 15.0, "section": 3.0, "div": 5.0, "blockquote": 3.0}
LEAST_PARAGRAPH = 25
SIBLING_SHARE = 0.2


class Node:
    __slots__ = ("tag", "attributes", "children", "parent", "points")

    def __init__(self, tag: str, attributes: str, parent: Node | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.points = 0.0


def parse(page: str) -> Node:
    """The element tree of a page; broken markup is closed as described above."""
    root = at = Node("html", "", None)
    position, end = 0, len(page)
    while position < end:
        found = MARKUP.search(page, position)
        if found is None:
            at.children.append(page[position:])
            break
        if found.start() > position:
            at.children.append(page[position : found.start()])
        position = found.end()
        tag = found[2]
        if tag is None or not found[4]:
            continue  # a comment, a declaration, or a tag that the page's end cuts off
        tag = tag.lower()
        if found[1]:
            node = at
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                at = node.parent
            continue
        at = _ended(at, tag)
        node = Node(tag, found[3], at)
        at.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, position)
            node.children.append(page[position : close.start() if close else end])
            position = close.start() if close else end
            at = node
        elif tag not in VOID and not found[3].rstrip().endswith("/"):
            at = node
    return root


def _ended(at: Node, tag: str) -> Node:
    """Where a start tag goes once what it implicitly ends is closed."""
    ends, bounds = ENDS.get(tag, (None, None))
    if tag in BLOCKS and tag not in ("html", "body"):
        node = at
        while node is not None and node.tag not in ("td", "th", "button", "div", "article", "section", "table"):
            if node.tag == "p":
                at = node.parent
                break
            node = node.parent
    if ends:
        node = at
        while node is not None and node.tag not in bounds:
            if node.tag in ends:
                return node.parent
            node = node.parent
    return at


def _attributes(node: Node) -> dict[str, str]:
    return {
        m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "")
        for m in ATTRIBUTE.finditer(node.attributes)
    }


def _foreign(node: Node, in_article: bool) -> bool:
    """Whether the element is no part of an article."""
    if node.tag in LEFT_OUT:
        return True
    if node.tag == "header" and not in_article:
        return True
    if not node.attributes:
        return False
    given = _attributes(node)
    if "hidden" in given or given.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")):
        return True
    if node.tag in ("article", "main", "body", "html") or node.tag in HEADINGS:
        return False
    words = {
        w.lower()
        for name in ("class", "id", "role")
        for w in CLASS_WORD.findall(given.get(name, ""))
    }
    return bool(words & FOREIGN) or (not in_article and bool(words & OUTER_FOREIGN))


def _prune(root: Node) -> None:
    stack = [(root, False)]
    while stack:
        node, in_article = stack.pop()
        in_article = in_article or node.tag in ("article", "main")
        node.children = [
            c for c in node.children if isinstance(c, str) or not _foreign(c, in_article)
        ]
        stack.extend((c, in_article) for c in node.children if not isinstance(c, str))


def _ordered(root: Node) -> list[Node]:
    """Elements in page order, parents before their children."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return found


def _lengths(nodes: list[Node]) -> dict[Node, tuple[int, int]]:
    """Characters of text and of linked text in each element."""
    sizes: dict[Node, tuple[int, int]] = {}
    for node in reversed(nodes):
        own = linked = 0
        for child in node.children:
            if isinstance(child, str):
                own += len(child.strip())
            else:
                own += sizes[child][0]
                linked += sizes[child][1]
        sizes[node] = (own, own if node.tag == "a" else linked)
    return sizes


def _score(nodes: list[Node]) -> dict[Node, float]:
    for node in nodes:
        node.points = CONTAINERS.get(node.tag, 0.0)
    own_text: dict[Node, list[str]] = {}
    for node in nodes:
        # Text counts for the paragraph that it is in, or for the block that holds it bare.
        for child in node.children:
            if isinstance(child, str) and child.strip():
                holder = node
                while holder.parent is not None and holder.tag not in PARAGRAPHS and holder.tag not in BLOCKS:
                    holder = holder.parent
                own_text.setdefault(holder, []).append(child)
    for holder, parts in own_text.items():
        text = " ".join(" ".join(parts).split())
        if len(text) < LEAST_PARAGRAPH or holder.tag in HEADINGS:
            continue
        points = 1.0 + text.count(",") + min(len(text) / 100.0, 3.0)
        bare = holder.tag not in PARAGRAPHS
        node, level = (holder, 0) if bare else (holder.parent, 0)
        while node is not None and level < 6:
            node.points += points / (1.0 if level == 0 else 2.0 if level == 1 else 3.0 * level)
            node, level = node.parent, level + 1
    sizes = _lengths(nodes)
    return {
        node: node.points * (1.0 - (sizes[node][1] / sizes[node][0] if sizes[node][0] else 0.0))
        for node in nodes
    }


def _kept(root: Node) -> list[Node]:
    """The best container, or its article, with the siblings that belong to it."""
    nodes = _ordered(root)
    scores = _score(nodes)
    sizes = _lengths(nodes)
    fit = [n for n in nodes if n.tag in CONTAINERS and sizes[n][0]] or [n for n in nodes if sizes[n][0]]
    if not fit:
        return []
    best = max(fit, key=lambda n: scores[n])
    node = best
    while node is not None and node.tag != "article":
        node = node.parent
    if node is not None:
        return [node]
    if best.parent is None or best.tag in ("main", "body"):
        return [best]
    least = max(10.0, SIBLING_SHARE * scores[best])
    kept, before = [], True
    for sibling in best.parent.children:
        if isinstance(sibling, str):
            continue
        if sibling is best:
            before = False
            kept.append(sibling)
            continue
        size, linked = sizes[sibling]
        density = linked / size if size else 1.0
        heading = sibling.tag in HEADINGS and before and density < 0.5
        prose = sibling.tag in PARAGRAPHS and density < 0.25 and size > 80
        rich = sibling.tag in CONTAINERS and scores[sibling] - CONTAINERS[sibling.tag] >= least
        if heading or prose or rich:
            kept.append(sibling)
    return kept


def _blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks of ``nodes`` in page order."""
    blocks: list[str] = []
    held: list[str] = []

    def end() -> None:
        text = " ".join(references.unescape("".join(held)).split())
        if text:
            blocks.append(text)
        held.clear()

    for root in nodes:
        stack: list[Node | str | None] = [root]
        while stack:
            item = stack.pop()
            if item is None:
                end()
            elif isinstance(item, str):
                held.append(item)
            elif item.tag == "br":
                held.append(" ")
            else:
                block = item.tag in BLOCKS
                if block:
                    end()
                    stack.append(None)
                elif item.tag in ("td", "th"):
                    held.append(" ")
                    stack.append(" ")
                stack.extend(reversed(item.children))
        end()
    return blocks


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    return "\n\n".join(_blocks(_kept(root)))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, in one pass without a shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html"
    )
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
