"""Web pages as text blocks in a folded tree of their elements.

The reader is lenient: it knows the end tags that may be left out, passes over stray ones,
and takes unclosed markup as open to the end.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Collection
from dataclasses import dataclass, field
from html import unescape

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</[^a-zA-Z][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_MARKED = re.compile(r"class|id|role|hidden|style", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What they hold is not markup, up to their end tag.
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
# Never text of the page.
UNSEEN = frozenset("audio button canvas datalist map object select svg template video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
# A start tag ends the open elements named here, up to one of those behind them.
_LI, _TABLE = frozenset(["ol", "ul", "menu", "dir"]), frozenset(["table"])
_ENDS = {
    "li": (frozenset(["li"]), _LI), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "caption"]), _TABLE), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "tbody": (frozenset(["thead", "tbody", "tfoot", "caption"]), _TABLE),
    "tfoot": (frozenset(["thead", "tbody", "tfoot"]), _TABLE), "thead": (frozenset(["tbody", "caption"]), _TABLE), "body": (frozenset(["head"]), frozenset(["html"])),
}
_A = (frozenset(["a"]), BLOCK)
_P = (frozenset(["p"]), frozenset(["button", "td", "th", "caption", "object"]))

BOILERPLATE_TAGS = frozenset("aside dialog footer form menu nav".split())
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert alerts aside banner breadcrumb breadcrumbs comment "
    "commentlist comments consent cookie cookies discussion disqus footer gdpr hidden login masthead menu menubar modal "
    "nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related "
    "replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
# The head of a page, unless one of the others says that it is the head of an article.
HEAD_WORDS = frozenset(["header"])
_OF_ARTICLE = frozenset("article content entry post section story title".split())
# Words that turn the meaning round: a layout with a sidebar is not the sidebar.
_TURNED = frozenset("has no with without".split())
# Deeper elements share the node of the last level: coarser, but no text is lost.
DEPTH = 40
CLASSES = 32


@dataclass
class Node:
    """Elements of equal signature under one parent, and the texts that stand right in them."""

    sig: str
    depth: int
    children: dict[str, "Node"] = field(default_factory=dict)
    texts: list[str] = field(default_factory=list)
    links: int = 0

    def child(self, sig: str) -> "Node":
        if self.depth == DEPTH:
            return self
        if sig not in self.children:
            self.children[sig] = Node(sig, self.depth + 1)
        return self.children[sig]


def signature(tag: str, attributes: str) -> str:
    """Tag, ``!`` when the markup itself names it boilerplate or ``^`` a header, and a short hash of
    its class."""
    boiler, head = tag in BOILERPLATE_TAGS, tag == "header"
    mark = ""
    if attributes and _MARKED.search(attributes):
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
        named = found.get("class") or found.get("id") or ""
        words = {w.lower() for w in _WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")}
        if tag not in ("html", "body", "main") and words & BOILERPLATE_WORDS and not (words & _TURNED):
            boiler = tag != "article" or bool(words & {"comment", "comments", "reply", "related", "promo", "ad", "sponsored"})
        head |= tag not in ("html", "body", "main", "article") and bool(words & HEAD_WORDS) and not words & (_OF_ARTICLE | _TURNED)
        boiler |= found.get("role", "").lower() in BOILERPLATE_ROLES or "hidden" in found
        boiler |= found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        if found.get("role", "").lower() in ("main", "article") and not boiler:
            tag = found["role"].lower()
        shape = " ".join(sorted(re.sub(r"\d+", "", named).split()))
        mark = f".{zlib.crc32(shape.encode('utf-8', 'replace')) % CLASSES}" if shape else ""
    return f"{tag}{'!' if boiler else '^' if head else ''}{mark}"


_PLAIN = {tag: signature(tag, "") for tag in BLOCK}


def read_page(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The folded tree of a page, and its blocks in page order with the nodes they stand in.

    Character references are decoded and white space inside a block is one space.
    """
    root = Node("#", 0)
    stack: list[tuple[str, Node, bool]] = []  # open elements: tag, node, whether their text is unseen
    opened: defaultdict[str, int] = defaultdict(int)  # open elements by tag
    blocks: list[tuple[Node, str]] = []
    pieces: list[str] = []
    node, unseen, links, at, end = root, False, 0, 0, len(page)

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                node.texts.append(text)
                node.links += min(links, len(text))
                blocks.append((node, text))
            pieces.clear()
        links = 0

    def cut(to: int) -> None:
        """End the open elements from place ``to`` on."""
        nonlocal node, unseen
        for tag, _, _ in stack[to:]:
            opened[tag] -= 1
            if tag in BLOCK:
                flush()
        del stack[to:]
        node, unseen = (stack[-1][1], stack[-1][2]) if stack else (root, False)

    def close(ended: Collection[str], until: Collection[str]) -> None:
        for tag in ended:
            if opened[tag]:
                break
        else:
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ended:
                return cut(k)
            if stack[k][0] in until:
                return

    while at < end:
        token = _TOKEN.search(page, at)
        stop = token.start() if token else end
        if stop > at and not unseen:
            text = unescape(page[at:stop])
            pieces.append(text)
            if opened["a"]:
                links += len(text)
        if token is None:
            break
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            if tag == "p":
                flush()  # one that ends no paragraph stands for an empty one
            close((tag,), () if tag in BLOCK else BLOCK)
            continue
        if tag in RAW:
            closing = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = closing.start() if closing else end
            continue
        if tag == "br":
            pieces.append(" ")
        if tag in BLOCK:
            flush()
            if tag in _ENDS:
                close(*_ENDS[tag])
            elif opened["p"]:
                close(*_P)
        elif tag == "a" and opened["a"]:
            close(*_A)
        if tag in VOID:
            continue
        if tag in BLOCK:
            node = node.child(signature(tag, token[3]) if token[3] else _PLAIN[tag])
        elif not unseen:
            unseen = tag in UNSEEN or bool(token[3]) and _MARKED.search(token[3]) is not None and "!" in signature(tag, token[3])
        stack.append((tag, node, unseen))
        opened[tag] += 1
    flush()
    return root, blocks
