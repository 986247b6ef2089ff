"""Main text of web pages by wrapper induction: what a host's pages share is its template.

1. Every page becomes a folded tree: sibling elements of equal signature (tag and class) are
   one node, so lists and runs of paragraphs are one node however long they are.
2. The trees of a host are aligned by simple tree matching: roots match when their signatures
   do, and children by the order-keeping choice of pairs with the largest sum of matches. What is
   aligned becomes one node of the host's template, the rest is added. Tasks align the pages
   they read; the templates of the tasks are aligned with each other, in two rounds, so no
   task sees all pages of a hot host.
3. A template node whose text is the same on all pages that have it, while these pages'
   main parts differ, is constant: it belongs to the template. The others are slots. A slot is
   content unless the markup names it a menu, header, footer, notice, advert or the like, or
   most of its text on all pages is links; a header is one unless a varying title stands in it.
   Where the template has an article or main
   element, content lies inside it.
4. Every page is aligned with its host's template, and the blocks of its content slots are its
   text. Nodes that align with none follow the node above them.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauge_engine.llm.html_blocks import Node, read_page
from gauge_engine.llm.shipping import ship_package
from gauge_engine.llm.url_filter import url_host
from gauge_engine.session import materialize

# A constant needs so many different main parts around it.
DIFFERENT_PAGES = 3
# Partial templates of the first round of merging meet in so many groups a host.
FIRST_ROUND = 64
# A task hands on its templates when it holds so many nodes of them.
HELD_NODES = 200_000
LINK_SHARE = 0.5
# An article or main element counts as the region of the content from this share of the text on.
REGION_SHARE = 0.2

_PARTIAL = "host string, part bigint, tree string"
_WRAPPER = "host string, wrapper string"


class Template:
    """A node of a host's template and what its pages hold there.

    ``same`` is the hash of the text that all pages share, or None; ``mains`` are the smallest
    hashes of these pages' main parts, at most ``DIFFERENT_PAGES``.
    """

    __slots__ = ("sig", "same", "mains", "chars", "links", "children")

    def __init__(self, sig: str, same: int | None, mains: list[int], chars: int, links: int, children: dict) -> None:
        self.sig, self.same, self.mains, self.chars, self.links, self.children = sig, same, mains, chars, links, children

    @property
    def tag(self) -> str:
        return self.sig.partition(".")[0].rstrip("!^")

    @property
    def boilerplate(self) -> bool:
        return "!" in self.sig

    @property
    def header(self) -> bool:
        return "^" in self.sig

    @property
    def constant(self) -> bool:
        return self.same is not None and len(self.mains) == DIFFERENT_PAGES

    def packed(self) -> list:
        return [self.sig, self.same, self.mains, self.chars, self.links, [c.packed() for c in self.children.values()]]

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children.values())


def unpacked(packed: list) -> Template:
    sig, same, mains, chars, links, children = packed
    return Template(sig, same, mains, chars, links, {c[0]: unpacked(c) for c in children})


def page_template(root: Node) -> Template:
    """The template of a single page."""

    def largest(node: Node, best: tuple[int, str]) -> tuple[int, str]:
        if "!" in node.sig:
            return best
        own = sum(map(len, node.texts)) - node.links
        if own > best[0]:
            best = (own, "\n".join(node.texts))
        for child in node.children.values():
            best = largest(child, best)
        return best

    main = xxhash.xxh64_intdigest(largest(root, (0, ""))[1].encode("utf-8", "replace"))

    def build(node: Node) -> Template:
        same = xxhash.xxh64_intdigest("\n".join(node.texts).encode("utf-8", "replace"))
        return Template(
            node.sig, same, [main], sum(map(len, node.texts)), node.links, {s: build(c) for s, c in node.children.items()}
        )

    return build(root)


def _heaviest_in_order(pairs: list[tuple[int, int]]) -> list[int]:
    """Places of the rising choice of (position, weight) with the largest sum of weights."""
    tops: list[tuple[int, int, int]] = []  # rising positions with rising sums, and the place that ends there
    back: list[int] = []
    for place, (position, weight) in enumerate(pairs):
        k = bisect_left(tops, (position,))
        total = weight + (tops[k - 1][1] if k else 0)
        back.append(tops[k - 1][2] if k else -1)
        end = k
        while end < len(tops) and tops[end][1] <= total:
            end += 1
        if end > k or k == len(tops) or tops[k][0] != position:
            tops[k:end] = [(position, total, place)]
    chosen, place = [], tops[-1][2] if tops else -1
    while place >= 0:
        chosen.append(place)
        place = back[place]
    return chosen[::-1]


class TreeMatch:
    """Simple tree matching of a template with another one, or with a page's tree."""

    def __init__(self) -> None:
        self.aligned: dict[tuple[int, int], tuple[int, set[str]]] = {}

    def score(self, left, right) -> int:
        """Matched nodes of two trees whose roots match."""
        return self._match(left, right)[0]

    def pairs(self, left, right) -> set[str]:
        """Signatures of the children that are matched."""
        return self._match(left, right)[1]

    def _match(self, left, right) -> tuple[int, set[str]]:
        key = (id(left), id(right))
        if key not in self.aligned:
            position = {sig: k for k, sig in enumerate(left.children)}
            common = [sig for sig in right.children if sig in position]
            weights = [self.score(left.children[sig], right.children[sig]) for sig in common]
            kept = _heaviest_in_order([(position[sig], w) for sig, w in zip(common, weights)])
            self.aligned[key] = (1 + sum(weights[k] for k in kept), {common[k] for k in kept})
        return self.aligned[key]


def _spoil(node: Template) -> None:
    node.same = None
    for child in node.children.values():
        _spoil(child)


def merge(into: Template, other: Template) -> None:
    """Align ``other`` with ``into`` and add it there. Nodes of equal signature that are not in
    the same order are no match: they stay one node, whose text is no constant."""
    match = TreeMatch()

    def add(left: Template, right: Template) -> None:
        matched = match.pairs(left, right)
        left.same = left.same if left.same == right.same else None
        left.mains = sorted({*left.mains, *right.mains})[:DIFFERENT_PAGES]
        left.chars += right.chars
        left.links += right.links
        for sig, child in right.children.items():
            if sig not in left.children:
                left.children[sig] = child
                continue
            add(left.children[sig], child)
            if sig not in matched:
                _spoil(left.children[sig])

    add(into, other)


def wrapper(template: Template) -> list:
    """The template with a decision for each node: ``[sig, decision, children]``.

    ``c`` content, ``t`` constant, ``l`` links, ``b`` boilerplate with all below it, ``o``
    outside the region of the content.
    """
    text: dict[int, int] = {}

    def weigh(node: Template) -> int:
        own = 0 if node.boilerplate else node.chars - node.links + sum(weigh(c) for c in node.children.values())
        text[id(node)] = own
        return own

    def regions(node: Template, tag: str) -> list[Template]:
        if node.boilerplate:
            return []
        if node.tag == tag:
            return [node]
        return [r for c in node.children.values() for r in regions(c, tag)]

    total = weigh(template)
    region: list[Template] = []
    for tag in ("article", "main"):
        region = regions(template, tag)
        if region and sum(text[id(r)] for r in region) >= REGION_SHARE * total:
            break
        region = []
    inside = {id(r) for r in region}

    def titled(node: Template) -> bool:
        """Whether a heading of the first level varies in it: the head of the article itself."""
        return (node.tag == "h1" and not node.constant) or any(titled(c) for c in node.children.values())

    def decide(node: Template, within: bool) -> list:
        entered = within or id(node) in inside
        page_head = node.header and not within and (region or not titled(node))
        if node.boilerplate or page_head or (node.tag == "article" and within and region):
            return [node.sig, "b", []]
        if region and not entered:
            decision = "o"
        elif node.constant:
            decision = "t"
        elif not region and node.chars and node.links >= LINK_SHARE * node.chars:
            decision = "l"
        else:
            decision = "c"
        return [node.sig, decision, [decide(c, entered) for c in node.children.values()]]

    return decide(template, False)


class Wrapper:
    """A decided template as a tree to align pages with."""

    __slots__ = ("sig", "decision", "children")

    def __init__(self, packed: list) -> None:
        self.sig, self.decision = packed[:2]
        self.children = {c[0]: Wrapper(c) for c in packed[2]}


@lru_cache(maxsize=256)
def _loaded(packed: str) -> Wrapper:
    return Wrapper(json.loads(packed))


def _content(root: Node, blocks: list[tuple[Node, str]], made: Wrapper) -> list[str]:
    match, decided = TreeMatch(), {}

    def follow(node: Node, known: Wrapper | None, above: str) -> None:
        if known is not None:
            decision = known.decision
        elif "!" in node.sig or above == "b":
            decision = "b"
        elif above == "o":
            decision = "c" if node.sig.partition(".")[0] in ("article", "main") else "o"
        else:
            decision = "l" if above == "l" else "c"
        decided[id(node)] = decision
        matched = match.pairs(known, node) if known is not None else ()
        for sig, child in node.children.items():
            under = known.children[sig] if sig in matched and decision != "b" else None
            follow(child, under, decision)

    follow(root, made, "o")
    return [text for node, text in blocks if decided[id(node)] == "c"]


def page_text(page: str | None, made: str | None) -> str:
    """The content of a page under its host's wrapper. A page that has none of the host's
    content slots is judged by itself."""
    if not page:
        return ""
    root, blocks = read_page(page)
    found = _content(root, blocks, _loaded(made)) if made else []
    if blocks and not found:
        found = _content(root, blocks, Wrapper(wrapper(page_template(root))))
    return "\n\n".join(found)


def _partials(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Templates of the pages of one task, by host."""
    task = TaskContext.get().partitionId()
    held: dict[str, Template] = {}
    nodes, sent = 0, 0

    def packed() -> pd.DataFrame:
        rows = [(host, (task << 20) + sent, json.dumps(tree.packed())) for host, tree in held.items()]
        return pd.DataFrame(rows, columns=["host", "part", "tree"])

    for frame in frames:
        for host, page in zip(frame["host"], frame["html"]):
            if not page:
                continue
            tree = page_template(read_page(page)[0])
            if host in held:
                merge(held[host], tree)
            else:
                held[host] = tree
            nodes += tree.size()
            if nodes >= HELD_NODES:
                nodes = sum(t.size() for t in held.values())
                if nodes >= HELD_NODES // 2:
                    yield packed()
                    held, nodes, sent = {}, 0, sent + 1
    yield packed()


def _merged(frame: pd.DataFrame) -> Template:
    trees = [unpacked(json.loads(t)) for t in frame.sort_values("part")["tree"]]
    for tree in trees[1:]:
        merge(trees[0], tree)
    return trees[0]


def _first_round(frame: pd.DataFrame) -> pd.DataFrame:
    tree = json.dumps(_merged(frame).packed())
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "part": [frame["part"].min()], "tree": [tree]})


def _last_round(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [json.dumps(wrapper(_merged(frame)))]})


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame["text"] = [page_text(page, made) for page, made in zip(frame.pop("html"), frame.pop("wrapper"))]
        yield frame


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text``: the main text of every row of ``pages``.

    Blocks follow in page order, joined by an empty line. Null and empty pages have an empty
    text. Pages without a host form a host of their own. Repeated rows each give a row; copies
    of one article do not make it a constant. Other columns are left out. Ids may be null.
    """
    ship_package(pages.sparkSession)
    taken = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), url_host(F.col(url_col)).alias("host"))
    sent = taken.select("host", "html").mapInPandas(_partials, _PARTIAL)
    first = sent.groupBy("host", F.pmod(F.xxhash64("part"), F.lit(FIRST_ROUND))).applyInPandas(_first_round, _PARTIAL)
    # Few rows of a few kilobytes a host; Spark chooses the join by their size.
    wrappers = materialize(first.groupBy("host").applyInPandas(_last_round, _WRAPPER), "wrappers")
    joined = taken.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    return joined.mapInPandas(_texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
