"""Main-text extraction from HTML by scoring the element tree.

Paragraphs pass points for their length and commas to their ancestors, discounted by link density. What is marked or named as page furniture or as reader comments is dropped, whatever
its size; a furniture word within a longer name lowers the score alone. The best container is kept: the outermost article or main element around it, with the articles beside it; on pages
without such elements, all its siblings and those of its ancestors that are not mostly links.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import partial
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import Carried, kept_arrays

# HTML element names by role, and the words of class, id and role attributes that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
DROPPED = frozenset("head nav header footer aside form menu dialog template svg math button select option object audio video canvas map script style textarea title iframe noembed noframes noscript xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("html body table td th caption button object article section main div ul ol dl aside nav header footer form".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertorial sponsor sponsored sponsors banner banners promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations pagination pager comment comments commentlist disqus replies respond form search searchbox skip outbrain taboola teaser complementary contentinfo copyright colophon responses".split()
)
# Words that begin names of adverts, offers and buttons, whatever follows; words of names that say where or in what shape something stands, not what it is.
LEADING = frozenset("ad ads adv advert adverts advertisement advertisements advertorial sponsor sponsored sponsors promo promos banner banners newsletter subscribe subscription share sharing social related recommended recommendations cookie cookies consent gdpr outbrain taboola".split())
SHAPES = frozenset("site top bottom global left right sticky fixed floating mobile desktop bar box link links list wrapper wrap container area section block inner outer button buttons icons slot unit panel row column zone card strip placeholder posts articles stories items".split())
#: Furniture words that in a longer name, or on a paragraph, say little of what the element is; last words of names of content; words that begin or end names of page states.
VAGUE = frozenset("form search social header teaser share sharing notice notices related recommended respond promotion overlay responses".split())
CONTENT = frozenset("article post entry content body text story main".split())
STATES = frozenset("has with without no is open opened closed on off enabled disabled allowed".split())
COMMENTS = frozenset("comment comments commentlist disqus replies".split())
KEPT_TAGS = frozenset("html body main".split())
ARTICLES = frozenset("article main".split())

TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
COMMA = re.compile("[,،、，]")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "named", "hinted", "comment", "inside", "length", "linked", "links", "commas", "score", "holds", "holds_main")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.dropped = self.named = self.hinted = self.comment = self.holds = self.holds_main = False
        self.inside = parent is not None and (parent.inside or parent.tag in ARTICLES)
        self.length = self.linked = self.links = self.commas = 0
        self.score = 0.0


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def _furniture(tag: str, attributes: dict[str, str]) -> tuple[bool, bool, bool]:
    """(named, hinted, comment): whether a whole name is a furniture term, whether furniture words stand in names at all, whether a name tells of reader comments.

    A whole name is one of furniture words alone or with words of shape (site-header, footer-links, top-bar), one that begins with a word for adverts, offers or sharing (ad-300x250, sponsored-content,
    related-posts), or the only name of its attribute if it ends in a furniture word that is not vague (skyscraper-ad). A name of comments begins or ends with a word for
    them (readerComments, comment-list). None of these ends or begins with a word of a state (has-comments, ads-disabled). An element that has another name of content as well
    (content right-sidebar) is hinted.
    """
    named = hinted = content = comment = False
    for key in ("class", "id", "role"):
        names = [[w.lower() for w in NAME_WORD.findall(x)] for x in attributes.get(key, "").split()]
        for words in names:
            if not words:
                continue
            state = words[0] in STATES or words[-1] in STATES
            comment |= not state and bool(COMMENTS.intersection((words[0], words[-1])))
            found = FURNITURE.intersection(words)
            if len(words) > 1 and "".join(words) in FURNITURE:
                found = set(words)
            first = words[0] in LEADING and not state
            content |= words[-1] in CONTENT and not first
            if not found:
                continue
            hinted = True
            if found == set(words):
                named |= tag != "p" or not found <= VAGUE
            elif first or (found | SHAPES).issuperset(words):
                named |= not state and (tag != "p" or not found <= VAGUE)
            elif len(names) == 1 and words[-1] in FURNITURE and words[-1] not in VAGUE:
                named |= not state
    return named and not content, hinted, comment


class _Open:
    """The open elements, with the places of each tag and of scopes, so that no tag climbs through all of them."""

    def __init__(self, root: Node):
        self.path: list[Node] = [root]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.path))
        if node.tag in SCOPE:
            self.scopes.append(len(self.path))
        self.path.append(node)

    def cut(self, place: int) -> None:
        """Closes the element at a place and all in it."""
        while len(self.path) > place:
            node = self.path.pop()
            self.places[node.tag].pop()
            if node.tag in SCOPE:
                self.scopes.pop()

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def close(self, tag: str) -> None:
        """An end tag: closes the last open element of its name; one of an inline element does not reach out of a scope."""
        place = self.last(tag)
        if place and not (tag in INLINE and self.scopes and self.scopes[-1] > place):
            self.cut(place)

    def imply(self, ends, stop) -> None:
        """Closes the first element of a tag in ends behind the last one of a tag in stop (None: a scope)."""
        last = (self.scopes[-1] if self.scopes else 0) if stop is None else max(self.last(t) for t in stop)
        found = []
        for tag in ends:
            places = self.places.get(tag, ())
            k = bisect_right(places, last)
            if k < len(places):
                found.append(places[k])
        if found:
            self.cut(min(found))


#: What an opening tag closes, and where the search for it stops.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
}


def parse(html: str) -> Node:
    """The element tree; children are nodes, or strings for text. Unclosed and stray tags are mended."""
    root = Node("#root", None)
    opened = _Open(root)
    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        node = opened.path[-1]
        if m is None:
            node.children.append(html[at:])
            break
        if m.start() > at:
            node.children.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            opened.close(tag)
            continue
        raw = m[3] or m[6] or ""
        if tag in CLOSES_P:
            opened.imply(("p",), None)
        elif tag in IMPLIED:
            opened.imply(*IMPLIED[tag])
        node = opened.path[-1]
        new = Node(tag, node)
        node.children.append(new)
        if tag in DROPPED:
            new.dropped = True
        if raw and not raw.isspace():
            attributes = _attributes(raw)
            if tag not in KEPT_TAGS:
                new.named, new.hinted, new.comment = _furniture(tag, attributes)
            if "hidden" in attributes or HIDDEN.search(attributes.get("style", "")):
                new.dropped = True
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            if close is None:
                at = end
            else:
                at = html.find(">", close.end())
                at = end if at < 0 else at + 1
            continue
        if tag not in VOID and not (raw.endswith("/") and tag in ("svg", "math")):
            opened.push(new)
    return root


def _measure(root: Node) -> list[Node]:
    """Sizes of every subtree, in document order of nodes. Dropped subtrees count nothing."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.dropped:
            continue
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                text = c.strip()
                node.length += len(text)
                node.commas += len(COMMA.findall(text))
            elif not c.dropped:
                node.length += c.length
                node.linked += c.length if c.tag == "a" else c.linked
                node.links += c.links + (c.tag == "a")
                node.commas += c.commas
                node.holds |= c.holds or c.tag in ARTICLES
                node.holds_main |= c.holds_main or c.tag == "main"
    return order


def _again(root: Node, order: list[Node]) -> list[Node]:
    for n in order:
        n.length = n.linked = n.links = n.commas = 0
        n.holds = n.holds_main = False
    return _measure(root)


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _is_block(node: Node) -> bool:
    return node.tag not in INLINE and node.tag != "br"


def _score(order: list[Node]) -> None:
    for node in order:
        own = node.length if node.tag in ("p", "pre", "blockquote", "td", "dd", "h1", "h2", "h3") else sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if not own or not _is_block(node) or node.tag == "#root":
            continue
        points = (1 + node.commas + min(own / 100, 3)) * (1 - _density(node))
        up, share = (node.parent if node.tag not in ("article", "main", "body", "div", "section") else node), 1.0
        level = 0
        while up is not None and level < 6:
            up.score += points * share
            level += 1
            share = 0.5 if level == 1 else 1 / (3 * level)
            up = up.parent
    for node in order:
        if node.tag in ("article", "main"):
            node.score += 25
        node.score *= (1 - _density(node)) * (0.8 if node.hinted else 1)


def _blocks(top: Node, out: list[str]) -> None:
    """Texts of the blocks below top, in page order."""
    words: list[str] = []

    def flush() -> None:
        if words:
            text = SPACE.sub(" ", unescape("".join(words))).strip()
            if text:
                out.append(text)
            words.clear()

    stack: list = [top]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            words.append(x)
        elif x.tag == "br":
            words.append("\n")
        elif not x.dropped:
            if _is_block(x):
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()


def _without_furniture(root: Node) -> list[Node]:
    """Drops furniture and comments; what is left, in document order."""
    order = _measure(root)
    gone = [n for n in order if n.comment]
    for n in gone:
        n.dropped = True
    if gone:
        order = _again(root, order)
    # an article on its own, or what holds the main element, is no furniture
    named = {n for n in order if n.named and not n.holds_main and (n.tag != "article" or n.inside)}
    under, free = set(), False
    for n in order:
        if n in named or n.parent in under:
            under.add(n)
        else:
            free |= n.tag in ARTICLES
    if not free:
        named = {n for n in named if not n.holds}
    gone = [*named, *(n for n in order if n.hinted and not n.named and not n.holds and _density(n) >= 0.5)]
    gone += [n for n in order if n.tag in ("ul", "ol") and n.links >= 3 and _density(n) >= 0.8 and not _in_text(n)]
    for n in gone:
        n.dropped = True
    return _again(root, order) if gone else order


def _in_text(links: Node) -> bool:
    """Whether a list of links is part of a text: in an article, or beside paragraphs in an element of the page."""
    if links.inside:
        return True
    up = links.parent
    if up is None or up.tag in ("#root", "html", "body"):
        return False
    return any(isinstance(c, Node) and c.tag == "p" and not c.dropped and c.length and _density(c) < 0.5 for c in up.children)


def extract(html: str | None) -> str:
    """The main text of one page, or an empty text."""
    if not html:
        return ""
    root = parse(html)
    order = _without_furniture(root)
    _score(order)
    out: list[str] = []
    holders = [n for n in order if n.tag not in INLINE and n.length and n.tag != "#root"]
    if not holders:
        _blocks(root, out)
        return " ".join(out)
    tops = [n for n in order if n.tag in ARTICLES and not n.inside and n.length]
    if tops:
        best = up = max((n for n in holders if n.inside or n in tops), key=lambda n: n.score)
        while up is not None:
            if up in tops:
                best = up
            up = up.parent
        for sibling in best.parent.children:
            if sibling is best or (sibling in tops and _density(sibling) < 0.5):
                _blocks(sibling, out)
        return " ".join(out)
    up = max(holders, key=lambda n: n.score)
    while up.parent is not None:
        for sibling in up.parent.children:
            if isinstance(sibling, Node) and sibling is not up and _is_block(sibling) and _density(sibling) >= 0.5:
                sibling.dropped = True
        up = up.parent
    _blocks(root, out)
    return " ".join(out)


def _extract(batches, html: str):
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column(batch.schema.get_field_index(html))]
        names, arrays = kept_arrays(batch)
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The main text of every page: keep columns, text, n_chars (code points).

    A header element is dropped whole, and with it a title inside an article's own header: what is kept is the article without headers.
    A null or empty page, and one without any main text, give an empty text. The whole page is read; repeated rows each give
    their row, an empty table gives none. Very long and deep pages are walked without recursion. Other columns of pages may have any names (text and n_chars too).
    """
    carried = Carried(pages, keep, html, ("text", "n_chars"))
    out = carried.run(partial(_extract, html=carried.text), "text string, n_chars long")
    return carried.restore(out, {"text": "text", "n_chars": "n_chars"})
