"""A page's block elements as a tree, and their features, for the extraction of its main text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Elements that make blocks; all others are inline and belong to the text around them.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements without content, and elements whose content is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template textarea title select option button iframe object svg canvas head".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: What may stand in a head: any other element, or text, closes it if its end tag is left out.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Opening one of these closes an open element of the same group.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("html body article aside section div main table ul ol dl td th blockquote form fieldset header footer nav figure details".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_LIST_END = re.compile(r"</(?:select|option|datalist)\b", re.I)
_WORDS = re.compile(r"[a-z]+")
_LISTS = frozenset(("table", "ul", "ol", "dl"))


@dataclass
class Node:
    """A block element: runs are its own stretches of text with the number of child blocks before each."""

    tag: str
    tokens: frozenset[str] = frozenset()
    parent: int = -1
    depth: int = 0
    children: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)
    tags: int = 1
    link_chars: int = 0
    main: bool = False


class Tokens:
    """The tags of a page in one pass: begin, end, whether it is an end tag, name and attributes (None for comments).

    A tag ends at the first > outside quotes. Where quotes don't close, they and all later ones are characters like
    others; where no > is left, the rest is text. So no part of a page is read again and again.
    """

    def __init__(self, page: str):
        self.page, self.quoted, self.at = page, True, 0

    def _end(self, at: int) -> int:
        """The place of the > that ends the tag, or -1."""
        begin = at
        while self.quoted:
            stop = _TAG_STOP.search(self.page, at)
            if stop is None:
                self.quoted = False
            elif stop[0] == ">":
                return stop.start()
            else:
                close = self.page.find(stop[0], stop.end())
                self.quoted = close >= 0
                at = close + 1
        return self.page.find(">", begin)

    def __iter__(self) -> Iterator[tuple[int, int, bool, str | None, str]]:
        page = self.page
        while (begin := page.find("<", self.at)) >= 0:
            self.at = begin + 1
            closes = page.startswith("/", begin + 1)
            name = _NAME.match(page, begin + 1 + closes)
            if name:
                end = self._end(name.end())
                if end < 0:
                    return
                self.at = end + 1
                yield begin, end + 1, closes, name[0].lower(), page[name.end() : end]
            elif page.startswith("!--", begin + 1):
                end = page.find("-->", begin + 4)
                self.at = len(page) if end < 0 else end + 3
                yield begin, self.at, False, None, ""
            elif page.startswith(("!", "?"), begin + 1):
                end = page.find(">", begin)
                if end < 0:
                    return
                self.at = end + 1
                yield begin, self.at, False, None, ""


class OpenElements:
    """The stack of open elements (name, node), with the places at which each name, blocks, scopes and lists stand."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.of: dict[str, list[int]] = {}
        self.blocks, self.scopes, self.lists = [0], [0], [0]
        self.kinds: dict[str, list[list[int]]] = {}

    def _kinds(self, tag: str) -> list[list[int]]:
        if (kinds := self.kinds.get(tag)) is None:
            kinds = self.kinds[tag] = [self.of.setdefault(tag, [])]
            kinds += [places for kind, places in ((BLOCKS, self.blocks), (_SCOPES, self.scopes), (_LISTS, self.lists)) if tag in kind]
        return kinds

    def push(self, tag: str, node: int) -> None:
        for places in self._kinds(tag):
            places.append(len(self.stack))
        self.stack.append((tag, node))

    def pop(self, to: int) -> list[str]:
        """Closes all elements from this place on; their names."""
        closed = [tag for tag, _ in self.stack[to:]]
        for tag in reversed(closed):
            for places in self._kinds(tag):
                places.pop()
        del self.stack[to:]
        return closed

    def last(self, *tags: str) -> int:
        """The place of the last open element of these names, 0 if there is none."""
        if len(tags) == 1:
            places = self.of.get(tags[0])
            return places[-1] if places else 0
        return max((self.of[t][-1] for t in tags if self.of.get(t)), default=0)

    def first(self, *tags: str) -> int:
        return min((self.of[t][0] for t in tags if self.of.get(t)), default=0)


def parse(page: str) -> list[Node]:
    """The page's block elements in document order, parents first; unclosed and stray tags are taken as browsers would, roughly.

    The time is in proportion to the page's length, whatever is in it.
    """
    nodes = [Node("html")]
    opened = OpenElements()
    stack = opened.stack
    text: list[str] = []
    links, dropped, at = 0, 0, 0
    list_end = max((m.start() for m in _LIST_END.finditer(page)), default=-1)

    def flush() -> None:
        joined = " ".join("".join(text).split())
        if joined:
            node = nodes[stack[-1][1]]
            node.runs.append((len(node.children), joined))
        text.clear()

    def put(piece: str) -> None:
        if stack[-1][0] == "head" and piece.strip():
            pop(len(stack) - 1)
        if piece and not dropped:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if links:
                nodes[stack[-1][1]].link_chars += len(piece.strip())

    def pop(to: int) -> None:
        nonlocal links, dropped
        if opened.blocks[-1] >= to:
            flush()
        for tag in opened.pop(to):
            links -= tag == "a"
            dropped -= tag in DROPPED

    tokens = Tokens(page)
    for begin, end, closes, tag, attributes in tokens:
        put(page[at:begin])
        at = end
        if tag is None:
            continue
        if closes:
            k = opened.last(tag)
            # A stray end of an inline element closes no block.
            if k and (tag in BLOCKS or opened.blocks[-1] < k):
                pop(k)
            continue
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            pop(len(stack) - 1)
        if dropped and tag in BLOCKS and at > list_end and (k := opened.first("select", "option")):
            pop(k)  # No end of a list of options follows: the block isn't part of one.
        nodes[stack[-1][1]].tags += 1
        if tag == "br":
            text.append(" ")
        if tag == "html" or (tag == "body" and opened.last("body")):
            continue
        if tag in BLOCKS:
            k = opened.last("p", *CLOSED_BY.get(tag, ()))
            if k and k >= (opened.lists if tag in CLOSED_BY else opened.scopes)[-1]:
                pop(k)
            flush()
            words: set[str] = set()
            main = False
            for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
                main |= name.lower() == "data-main"
                words.update(_WORDS.findall("".join(values).lower()))
            above = stack[-1][1]
            nodes.append(Node(tag, frozenset(words), above, nodes[above].depth + 1, main=main))
            nodes[above].children.append(len(nodes) - 1)
            if tag not in VOID:
                opened.push(tag, len(nodes) - 1)
        elif tag not in VOID and not attributes.endswith("/"):
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = tokens.at = close.end() if close else len(page)
                continue
            opened.push(tag, stack[-1][1])
            links += tag == "a"
            dropped += tag in DROPPED
    put(page[at:])
    pop(1)
    flush()
    return nodes


#: Words in class, id and role that tell boilerplate, comments and main text apart.
AWAY = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs consent cookie cookies copyright dialog footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pagination popup privacy promo recommended related share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets alert contentinfo complementary search".split())
COMMENT = frozenset("comment comments commentlist discussion disqus reply replies respond responses".split())
TOWARDS = frozenset("article body content entry main post story text".split())
_KINDS = (
    frozenset(("article", "main")), frozenset(("p", "blockquote", "pre")), frozenset(("h1", "h2", "h3", "h4", "h5", "h6")), frozenset(("li", "dd", "dt")), frozenset(("ul", "ol", "dl")),
    frozenset(("nav", "menu")), frozenset(("header", "footer", "aside")), frozenset(("form", "fieldset", "legend", "dialog")), frozenset(("table", "tbody", "tr", "td", "th")),
)

FEATURES = (
    "depth", "log_text", "text_per_tag", "link_share", "stops_per_char", "paragraphs", "text_per_block", "share_of_page", "share_of_parent",
    "away", "comment", "towards", "away_above", "comment_above", "towards_above", "kind_above", "place", "siblings", "log_sibling_text", "log_next_text",
    *(f"kind_{k}" for k in range(len(_KINDS))),
)


def features(nodes: list[Node]) -> np.ndarray:
    """A row of FEATURES for each node: of its whole subtree, its attributes and ancestors, and its siblings."""
    n = len(nodes)
    own = np.array([sum(len(t) for _, t in x.runs) for x in nodes], float)
    tags, links = np.array([x.tags for x in nodes], float), np.array([x.link_chars for x in nodes], float)
    stops = np.array([sum(t.count(".") + t.count(",") for _, t in x.runs) for x in nodes], float)
    paragraphs, blocks = np.array([x.tag == "p" for x in nodes], float), np.ones(n)
    chars = own.copy()
    parent = np.array([x.parent for x in nodes])
    for total in (chars, tags, links, stops, paragraphs, blocks):
        for k in range(n - 1, 0, -1):
            total[parent[k]] += total[k]
    kinds = np.array([[x.tag in kind for kind in _KINDS] for x in nodes], float)
    marks = np.array([[len(x.tokens & AWAY), len(x.tokens & COMMENT), len(x.tokens & TOWARDS)] for x in nodes], float)
    above, kind_above = np.zeros((n, 3)), np.zeros(n)
    away_kind = kinds[:, 5:8].any(axis=1)
    place, count, beside, after = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(1, n):
        p = parent[k]
        above[k] = np.maximum(above[p], marks[p])
        kind_above[k] = -1 if kind_above[p] < 0 or away_kind[p] else max(kind_above[p], kinds[p, 0])
    for x in nodes:
        c = np.array(x.children, dtype=np.int64)
        if len(c):
            place[c], count[c] = np.arange(len(c)) / len(c), len(c)
            beside[c] = (chars[c].sum() - chars[c]) / max(1, len(c) - 1)
            after[c[:-1]] = chars[c[1:]]
    depth = np.array([x.depth for x in nodes], float)
    mother = chars[np.maximum(parent, 0)]
    columns = [
        depth, np.log1p(chars), chars / tags, links / np.maximum(1, chars), stops / np.maximum(1, chars), paragraphs, chars / blocks, chars / max(1.0, chars[0]), chars / np.maximum(1, mother),
        *marks.T, *above.T, kind_above, place, count, np.log1p(beside), np.log1p(after), *kinds.T,
    ]
    return np.stack(columns, axis=1)


def decode(nodes: list[Node], logits: np.ndarray) -> np.ndarray:
    """Which nodes are kept: a set that holds every kept node's parent and has the largest sum of logits.

    A node's branch is worth its own logit and the positive branches below; it is kept if that is positive and the node
    above is. So no node contradicts its ancestors or descendants.
    """
    worth = logits.astype(float).copy()
    for k in range(len(nodes) - 1, 0, -1):
        worth[nodes[k].parent] += max(0.0, worth[k])
    kept = np.zeros(len(nodes), bool)
    kept[0] = worth[0] > 0
    for k in range(1, len(nodes)):
        kept[k] = worth[k] > 0 and kept[nodes[k].parent]
    return kept


def text_of(nodes: list[Node], kept: np.ndarray) -> str:
    """The kept nodes' stretches of text in document order, parted by empty lines."""
    out: list[str] = []
    todo: list[tuple[int, int, int]] = [(0, 0, 0)] if len(nodes) and kept[0] else []
    while todo:  # node, next child, next run
        k, child, run = todo.pop()
        node = nodes[k]
        while run < len(node.runs) and node.runs[run][0] <= child:
            out.append(node.runs[run][1])
            run += 1
        if child < len(node.children):
            todo.append((k, child + 1, run))
            if kept[node.children[child]]:
                todo.append((node.children[child], 0, 0))
    return "\n\n".join(out)
