"""Main text of web pages by tree scoring.

A page is cut into tags and text and read into a small tree. Boilerplate elements go first: those
of such a tag, role or style always, those of such a class or id unless they hold much of the page's
paragraph text or are a titled part of it, which lowers their points instead. Where little or
nothing is left, the page is scored again without the names.
Every paragraph then passes points for its length and commas to its ancestors, less with each
step up; a container's points are discounted by the share of its text that sits in links. The
best container (or the article or main element around it) is taken together with those of its
siblings that score or read like text, and the text of its blocks, in page order, is the result.

Edge cases: null and empty pages give an empty text; unclosed and stray tags are repaired the way
browsers do for paragraphs and list items; a page without any block element is one block; a page
whose blocks all are boilerplate without a paragraph gives an empty text; very long pages are read whole, in one pass,
and deep nesting is walked without recursion.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from peerscreen.llm.common import clear

# How elements take part.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
LOOSE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>")  # for tags whose quotes never close
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set(
    "script style noscript template iframe object embed svg math canvas audio video map head title"
    " nav aside footer form button select option textarea input label fieldset dialog menu header noembed noframes xmp".split()
)
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - set("body html li dd dt td th tr tbody thead tfoot".split())
#: A start tag ends an open element of these names up to the given borders.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
BOILERPLATE = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|notification|alert|disclaimer|popup|modal|overlay"
    r"|nav\w*|menus?|breadcrumbs?|toolbar|sidebars?|side|aside|related|recommend\w*|widgets?|footer|foot|header|masthead|topbar|site-?header|page-?header"
    r"|comments?|commentlist|disqus|replies|reply|respond|responses?|discussion|trending|popular|share|sharing|social|subscribe|subscription|newsletter|signup|login|search|pagination|pager|skip|copyright|legal)(?:$|[-_\s\d])",
    re.I,
)
LAYOUT = re.compile(r"\b(?:has|with|no|without)-[-\w]*", re.I)  # says what a page has, not what an element is
#: Names of what other people wrote or sell: these are spared only where nothing else is on the page.
FOREIGN = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|overlay|comments?|commentlist|disqus|replies|reply|respond|newsletter|subscri\w+|signup|login|pagination|pager)(?:$|[-_\s\d])",
    re.I,
)
CONTENT = re.compile(r"(?:^|\s)(?:\w{1,4}-)?(?:content|main|page|layout|article|entry|story)(?:$|\s)", re.I)
STATE = re.compile(r"(?:^|(?<=\s))[-\w]+-(?:left|right|top|bottom|fixed|sticky|static|open|opened|closed|on|off|active|visible|hidden|collapsed|expanded|none)(?=$|\s)", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Paragraph characters of the page that a named element must hold to be spared, and that a result must have to stand.
SPARED_SHARE, LEAST_SHARE, NAMED_POINTS = 0.4, 0.25, -5.0
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog", "alertdialog"}
READABLE = {"p", "h1", "h2", "h3", "h4", "blockquote", "pre", "figure", "table", "ul", "ol", "dl"}
PARAGRAPHS = {"p", "pre", "blockquote", "td", "li", "dd"}
TAG_POINTS = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "ul": -3.0, "ol": -3.0, "li": -3.0, "dl": -3.0}
CONTAINERS = {"article", "main", "section", "div", "td", "body", "blockquote", "center"}


class Node:
    __slots__ = ("name", "parent", "children", "dropped", "named", "points", "chars", "linked", "text", "depth", "block")

    def __init__(self, name: str, parent: Node | None, dropped: bool):
        self.name, self.parent, self.dropped = name, parent, dropped
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        self.block: Node = self if parent is None or name in BLOCK else parent.block  # the nearest block around
        self.points = TAG_POINTS.get(name, 0.0)
        self.chars = self.linked = 0
        self.named = ""  # what its class or id says: "", "id", "class" or "foreign"
        self.text = 0  # characters of the paragraphs in it


_depth = attrgetter("depth")


def _is_boilerplate(name: str, attributes: str, within_article: bool) -> bool:
    if name in DROPPED:
        return not (name == "header" and within_article)
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _named(name: str, attributes: str) -> str:
    if not attributes or name in HEADINGS or name in ("html", "body", "article", "main"):
        return ""
    found = ""
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), LAYOUT.sub("", value.strip("\"'"))
        if key == "class" and CONTENT.search(value):
            value = STATE.sub("", value)  # as in "content sidebar-right"
        if key in ("class", "id") and BOILERPLATE.search(value):
            if FOREIGN.search(value):
                return "foreign"
            found = "class" if key == "class" or found == "class" else "id"
    return found


def tree(html: str) -> Node:
    root = node = Node("body", None, False)
    at, n = 0, len(html)
    opened: defaultdict[str, list[Node]] = defaultdict(list)  # the open elements of each name, by depth

    def close(last: Node) -> Node:
        """Ends `last` and what is open inside it; the element that is then open."""
        walk: Node | None = node
        while walk is not last.parent:
            opened[walk.name].pop()
            walk = walk.parent
        return walk

    while at < n:
        start = html.find("<", at)
        if start < 0:
            node.children.append(html[at:])
            break
        m = TOKEN.match(html, start) or LOOSE.match(html, start)
        if m is None:  # a bare < is text
            node.children.append(html[at : start + 1])
            at = start + 1
            continue
        if start > at:
            node.children.append(html[at:start])
        at = m.end()
        name = (m.group(2) or "").lower() if m.re is LOOSE or m.lastindex else ""
        if not name or name in ("html", "body"):
            continue
        if m[1]:
            if opened[name]:
                node = close(opened[name][-1])
            continue
        if name in ENDS_PARAGRAPH:
            if node.block.name == "p":
                node = close(node.block)
        elif name in ENDS:
            names, borders = ENDS[name]
            border = max((opened[x][-1].depth for x in borders if opened[x]), default=0)
            inside = [opened[x][i] for x in names if (i := bisect_right(opened[x], border, key=_depth)) < len(opened[x])]
            if inside:
                node = close(min(inside, key=_depth))
        child = Node(name, node, node.dropped or _is_boilerplate(name, m[3], bool(opened["article"])))
        child.named = _named(name, m[3])
        node.children.append(child)
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        opened[name].append(child)
        node = child
    return root


def _in_order(root: Node) -> Iterator[Node]:
    """Parents before children, in page order, without dropped parts."""
    stack = [root]
    while stack:
        node = stack.pop()
        if not node.dropped:
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))


def blocks(parts: list[Node]) -> list[str]:
    """Texts of the blocks under `parts`, in page order, white space made one space."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join(unescape("".join(line)).split()):
            out.append(text)
        line.clear()

    for part in parts:
        stack: list[Node | str | None] = [part]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif x.dropped:
                continue
            elif x.name in BLOCK:
                flush()
                stack.append(None)
                stack.extend(reversed(x.children))
            elif x.name == "br":
                line.append("\n")
            else:
                stack.extend(reversed(x.children))
        flush()
    return out


def _own_text(nodes: list[Node]) -> dict[int, list[str]]:
    """Texts of paragraphs and containers by id(), with those of their inline elements; sizes from below."""
    own_text: dict[int, list[str]] = {}
    for node in nodes:
        node.chars = node.linked = 0
    for node in reversed(nodes):
        text = [c for c in node.children if isinstance(c, str)]
        node.chars += sum(len(t.strip()) for t in text)
        if node.name == "a":
            node.linked = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
        if node.name not in BLOCK and node.parent is not None and node.parent.name != "a":
            own_text.setdefault(id(node.parent), []).extend(own_text.pop(id(node), []) + text)
        else:
            own_text.setdefault(id(node), []).extend(text)
    ids = {id(n) for n in nodes if n.name in PARAGRAPHS or n.name in CONTAINERS}
    return {k: text for k, text in own_text.items() if k in ids and sum(map(len, text)) >= 25}


def _score(nodes: list[Node]) -> None:
    """Points of paragraphs to their ancestors."""
    own_text = _own_text(nodes)
    for node in nodes:
        node.points = NAMED_POINTS if node.named else TAG_POINTS.get(node.name, 0.0)
    for node in nodes:
        text = own_text.get(id(node))
        if not text:
            continue
        points = 1.0 + sum(t.count(",") + t.count("，") + t.count("、") for t in text) + min(sum(map(len, text)) // 100, 3)
        up = node.parent if node.name in PARAGRAPHS else node
        for share in (1.0, 0.5, 1 / 3, 0.25):
            if up is None:
                break
            up.points += points * share
            up = up.parent


def _judge(nodes: list[Node]) -> tuple[list[Node], list[Node]]:
    """Named elements to drop, and those of foreign names. Counts paragraph characters, without foreign ones, as Node.text."""
    own_text = _own_text(nodes)
    for node in reversed(nodes):
        if node.named != "foreign":
            node.text += sum(map(len, own_text.get(id(node), ())))
            if node.parent is not None:
                node.parent.text += node.text
    whole = nodes[0].text
    inside: set[int] = set()  # id() of articles and what is in them
    for node in nodes:
        if node.name in ("article", "main") or id(node.parent) in inside:
            inside.add(id(node))

    def part(node: Node) -> bool:
        """Whether an id names a part of the text, not what the element is for."""
        if node.named != "id" or not node.text or node.linked >= 0.25 * node.chars:
            return False
        first = next((c.name for c in node.children if isinstance(c, Node)), "")
        return node.name == "section" or first in HEADINGS or id(node) in inside

    foreign = [n for n in nodes if n.named == "foreign"]
    return [n for n in nodes if n.named in ("id", "class") and not part(n) and (not n.text or n.text < SPARED_SHARE * whole)], foreign


def _mark(parts: list[Node], dropped: bool) -> None:
    for node in parts:
        node.dropped = dropped


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = tree(html)
    nodes = list(_in_order(root))
    if not any(n.named for n in nodes):
        return _best_text(root)
    named, foreign = _judge(nodes)
    _mark(named + foreign, True)
    text = _best_text(root)
    if len(text) < LEAST_SHARE * root.text:
        _mark(named, False)
        text = max(text, _best_text(root), key=len)
    if not text and any(n.chars >= 25 for n in foreign):
        _mark(named + foreign, False)
        text = _best_text(root)
    return text


def _best_text(root: Node) -> str:
    nodes = list(_in_order(root))
    _score(nodes)

    def worth(node: Node) -> float:
        return node.points * (1 - node.linked / node.chars) if node.chars else 0.0

    candidates = [n for n in nodes if n.name in CONTAINERS and n.chars]
    if not candidates:
        return "\n".join(blocks([root]))
    best = max(candidates, key=worth)  # the first in page order where equal
    if best.parent is None:
        return "\n".join(blocks([best]))
    # Inside an article, or else a main element, that element is the container: its boilerplate is gone.
    for name in ("article", "main"):
        up = best
        while up is not None and up.name != name:
            up = up.parent
        if up is not None:
            best = up
            break
    # An only container of its parent's text stands for the parent.
    while best.parent.parent is not None and best.parent.chars == best.chars:
        best = best.parent
    least = max(10.0, worth(best) * 0.2)

    def belongs(c: Node) -> bool:
        if c.dropped or not c.chars:
            return False
        if c.name in CONTAINERS and worth(c) >= least:
            return True
        if c.linked / c.chars >= 0.25:
            return False
        return c.name in READABLE or c.name in CONTAINERS and any(isinstance(x, Node) and x.name in READABLE for x in c.children)

    parts = [c for c in best.parent.children if c is best or isinstance(c, Node) and belongs(c)]
    return "\n".join(blocks(parts))


def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield pa.array([main_text(p.as_py()) for p in pages], type=pa.string())


def extracted(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of each; an input column named `out` is replaced."""
    named = clear(pages.withColumn("_html", F.col(html).cast("string")), out)
    return named.withColumn(out, F.arrow_udf(extract, "string")("_html")).drop("_html")
