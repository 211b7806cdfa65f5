"""HTML extraction by tree scoring.

A page becomes a tree in which menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are marked as clutter by tag, role or class. Each paragraph passes points
for its length and its commas to its ancestors, less with each level; a container's points are
discounted by its link density. The article or main element around the best container is kept with
those siblings that score well too. Without one, the outermost ancestor that holds several children
with points is kept, from its first to its last child with text that isn't mostly links. Lists of
links are dropped outside the best container (or article or main element), not in it; a header inside
an article or main element is part of it. The blocks of text are joined in page order. Time grows with
the page's length, for deep inline nesting and end tags without an open element too.

Pages are independent rows in Arrow batches, so the job is one narrow stage without a shuffle.

Rows: null, empty and markup-only pages give an empty text; broken markup (unclosed or stray tags,
cut pages) is read as far as it goes; repeated rows each get a row; the nesting may be of any depth,
as nothing recurses. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLUTTER_TAGS = frozenset("script style noscript template iframe svg canvas object embed form input select button textarea option nav footer aside menu dialog head title".split())
CLUTTER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_CLUTTER = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|sidebar\w*|side|menu\w*|nav|navbar\w*|navigation|breadcrumbs?|footer\w*|header|masthead|topbar|"
    r"comments?|commentlist|disqus\w*|respond|replies|reply|reader-?comments?|cookies?|consent|gdpr|notices?|popup\w*|modal|overlay|newsletter\w*|subscri\w*|signup|login|"
    r"shar(?:e|ing)\w*|social\w*|related\w*|recommend\w*|widgets?|toolbar|pagination|pager|skip\w*|alert\w*|copyright|disclaimer|paywall|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
#: Names that also stand in names of chapters, and the words that they have beside them where they don't.
_SOFT = re.compile(r"(?:related|recommend\w*|skip\w*|comments?|social\w*|side|widgets?|notices?|shar(?:e|ing)|alert\w*|promo\w*|copyright|disclaimer|reply|replies|respond)\Z", re.I)
_FURNITURE = re.compile(
    r"(?:area|articles?|aside|bar|block|body|bottom|box|btn|buttons?|card|column|container|content|count|feed|footer|form|grid|group|header|holder|icons?|inner|items?|left|like|links?|list|main|media|"
    r"meta|module|more|news|outer|page|pages|panel|posts?|right|row|section|site|stories|story|strip|text|this|thread|title|to|tools?|top|wrap|wrapper|reader|readers|user|users|js|module|\d+)\Z",
    re.I,
)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content\w*|entry\w*|main\w*|post\w*|story\w*|text|page|hentry|prose)(?=$|[\s_-])", re.I)
#: Tags that an opening tag closes, if open, up to the nearest of the second set.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CONTAINERS = frozenset(("body", "div", "section", "article", "main", "td", "html", "center"))


class Node:
    __slots__ = ("tag", "parent", "kids", "clutter", "good", "score", "length", "links", "n_links")

    def __init__(self, tag: str, parent: Node | None, clutter: bool = False, good: bool = False):
        self.tag, self.parent, self.clutter, self.good = tag, parent, clutter, good
        self.kids: list[Node | str] = []
        self.score, self.length, self.links, self.n_links = 0.0, 0, 0, 0


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(text)} if text.strip(" /\n\t") else {}


def _furniture(token: str) -> bool:
    """Whether a class or id names clutter: `related-posts` does, `related-work` and `comments-on-method` don't."""
    if not _CLUTTER.search(token):
        return False
    parts = [p for p in re.split(r"[-_]+", token) if p]
    firm = [p for p in parts if _CLUTTER.search(p) and not _SOFT.match(p)]
    return bool(firm) or len(parts) == 1 or not any(_SOFT.match(p) for p in parts) or all(_SOFT.match(p) or _FURNITURE.match(p) for p in parts)


def _marks(tag: str, attrs: dict[str, str], parent: Node) -> tuple[bool, bool]:
    """Whether the element is clutter, and whether its class speaks for content."""
    name = f"{attrs.get('class', '')} {attrs.get('id', '')}" if attrs else ""
    clutter = tag in CLUTTER_TAGS or attrs.get("role", "").lower() in CLUTTER_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
    if not clutter and tag not in ("body", "html", "main", "a", "b", "i", "em", "strong", "span", *_HEADINGS) and name != " ":
        clutter = any(map(_furniture, name.split())) and not (tag == "article" and not re.search("comment|ad|promo|related", name, re.I))
    if tag == "header" and not clutter:
        up = parent
        while up and up.tag not in ("article", "main"):
            up = up.parent
        clutter = up is None
    return clutter, bool(name and _GOOD.search(name))


def _closed(at: Node, to: Node, n_open: Counter) -> Node:
    """Closes the open elements from `at` up to `to`, which stays open."""
    while at is not to:
        n_open[at.tag] -= 1
        at = at.parent
    return to


def parse(page: str) -> Node:
    root, n_open = Node("html", None), Counter()
    at, pos, n = root, 0, len(page)
    for m in iter(lambda: _TOKEN.search(page, pos) if pos < n else None, None):
        if m.start() > pos:
            at.kids.append(page[pos : m.start()])
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                at.kids.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if m[1] or m[4]:  # an end tag closes the nearest open element of its name
            up = at if n_open[tag] else root  # without an open one, no walk
            while up is not root and up.tag != tag:
                if up.tag in ("td", "th", "table") and tag not in BLOCKS:
                    break
                up = up.parent
            if up is not root and up.tag == tag:
                at = _closed(at, up.parent, n_open)
            continue
        if tag == "html" or tag == "body" and at.tag == "body":
            continue
        if tag in BLOCKS and n_open["p"]:
            up = at  # a block ends an open paragraph
            while up is not root and up.tag not in ("p", "td", "th", "button", "table") and not (up.tag in BLOCKS and up.tag != "p"):
                up = up.parent
            if up.tag == "p":
                at = _closed(at, up.parent, n_open)
        if tag in _CLOSES:
            closes, until = _CLOSES[tag]
            up, last, left = at, None, sum(n_open[t] for t in closes)
            while left and up is not root and up.tag not in until:
                if up.tag in closes:
                    last, left = up, left - 1
                up = up.parent
            if last is not None:
                at = _closed(at, last.parent, n_open)
        attrs = _attributes(m[3] or m[6] or "")
        node = Node(tag, at, *_marks(tag, attrs, at))
        if tag in RAW:  # its content is text up to its own end tag
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        at.kids.append(node)
        if tag not in VOID and not (m[3] or m[6] or "").endswith("/"):
            at = node
            n_open[tag] += 1
    if pos < n:
        at.kids.append(page[pos:])
    return root


def _ordered(root: Node) -> list[Node]:
    """All nodes without clutter, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.clutter:
            out.append(node)
            stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    return out


def score(root: Node) -> list[Node]:
    """Fills lengths and points; the nodes without clutter, parents first."""
    nodes = _ordered(root)
    inline: dict[Node, list[str]] = {}
    around: dict[Node, tuple[Node, bool]] = {}  # the block that a node is in, and whether by way of a link
    for node in nodes:
        if node.tag in BLOCKS or node.parent is None:
            block, link = node, False
        else:
            block, link = around[node.parent]
            link |= node.tag == "a"
        around[node] = block, link
        own = [k for k in node.kids if isinstance(k, str)]
        size = sum(len(" ".join(k.split())) for k in own)
        node.length += size
        if not size:
            continue
        if link:
            node.links += size
        inline.setdefault(block, []).extend(own)
    for node in reversed(nodes):
        node.n_links += node.tag == "a"
        if node.parent:
            node.parent.length += node.length
            node.parent.links += node.links
            node.parent.n_links += node.n_links
    for block, parts in inline.items():
        text = "".join(parts)
        size = len(" ".join(text.split()))
        if not size or block.tag in _HEADINGS:
            continue
        points = 1 + text.count(",") + min(size / 100, 3)
        up, level = (block if block.tag in _CONTAINERS else block.parent), 0
        while up is not None and level < 6:
            up.score += points / (1, 2, 6, 9, 12, 15)[level]
            up, level = up.parent, level + 1
    for node in nodes:
        if node.score:
            node.score += 5 * (node.tag in ("article", "main")) + 3 * node.good
            node.score *= 1 - node.links / max(1, node.length)
    return nodes


def _link_list(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.n_links >= 2 and node.links > 0.5 * node.length


def _text_bearing(k: Node | str) -> bool:
    """Whether a child has text that isn't mostly links."""
    if isinstance(k, str):
        return bool(k.strip())
    return not k.clutter and k.length > 0 and k.links < 0.25 * k.length


def _drop_link_lists(top: Node) -> None:
    for node in _ordered(top):
        node.clutter = node.clutter or _link_list(node)


def _between(holder: Node, way: set[Node]) -> Node:
    """The holder with its children from the first to the last that bear text or lead to the best."""
    bearing = [i for i, k in enumerate(holder.kids) if k in way or _text_bearing(k)]
    out = Node(holder.tag, None)
    out.kids = holder.kids[bearing[0] : bearing[-1] + 1] if bearing else []
    return out


def _with_siblings(best: Node) -> list[Node]:
    """An article or main element and its siblings: inside a main element all that bear text, elsewhere other articles
    and those that score well too."""
    if best.parent is None:
        return [best]
    kept, least, up = [], max(4.0, 0.2 * best.score), best.parent
    while up is not None and up.tag != "main":
        up = up.parent
    for k in best.parent.kids:
        if isinstance(k, str):
            if up is not None and k.strip():
                kept.append(Node("p", None))
                kept[-1].kids.append(k)
            continue
        if k.clutter:
            continue
        density = k.links / max(1, k.length)
        beside = up is not None or k.tag == best.tag == "article"
        if k is best or k.tag == "h1" or density < 0.25 and (beside and k.length or k.score >= least or k.tag == "p" and k.length >= 80):
            if k is not best:
                _drop_link_lists(k)
            kept.append(k)
    return kept


def chosen(root: Node) -> list[Node]:
    nodes = score(root)
    holders = [x for x in nodes if x.tag in _CONTAINERS and x.score > 0]
    if not holders:
        _drop_link_lists(root)
        return [root]
    best = max(holders, key=lambda x: x.score)
    for name in ("article", "main"):  # the outermost of this name around it
        up, found = best, None
        while up is not None:
            if up.tag == name:
                found = up
            up = up.parent
        if found is not None:
            return _with_siblings(found)
    # without either, the outermost ancestor that holds several children with points
    holder, way, up = best, [best], best
    while up.parent is not None:
        up = up.parent
        way.append(up)
        if sum(isinstance(k, Node) and (k.score > 0 or k.tag == "p") and _text_bearing(k) for k in up.kids) > 1:
            holder = up
    if holder is best and best.parent is not None and best.tag != "body":
        holder = best.parent  # headings and the like beside it
    on_way = set(way)
    for node in way[: way.index(holder) + 1]:
        for k in node.kids if node is not best else ():
            if isinstance(k, Node) and k not in on_way:
                _drop_link_lists(k)
    return [_between(holder, on_way)]


def blocks_of(tops: list[Node]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush():
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    for top in tops:
        stack: list = [top]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                run.append(item)
            elif item.tag == "br":
                run.append(" ")
            elif not item.clutter:
                block = item.tag in BLOCKS
                if block:
                    flush()
                    stack.append(None)
                stack.extend(reversed(item.kids))
        flush()
    return out


def extract(page: str | None) -> str:
    return "\n".join(blocks_of(chosen(parse(page)))) if page else ""


def _extract(batches):
    for batch in sliced(batches, "html"):
        texts = [extract(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
