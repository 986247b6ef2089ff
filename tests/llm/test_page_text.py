"""Main text of pages: reading of markup, tree matching, layouts with and without an article element."""

import html
import random
import re
from itertools import combinations
from pathlib import Path

import pytest

from gauge_engine.llm import page_text as pt
from gauge_engine.llm.catalog import QUERIES
from gauge_engine.llm.html_blocks import DEPTH, Node, read_page
from gauge_engine.llm.page_text import TreeMatch, _heaviest_in_order, extract_text, page_template

DATA = Path("/root/testdata/sf0.01")
SCHEMA = "page_id bigint, url string, html string, text string, host string, wrapper string"


def texts(spark, pages, parts=3):
    df = spark.createDataFrame([(*p, "x", "y", "z") for p in pages], SCHEMA).repartition(parts)
    return {r.page_id: r.text for r in extract_text(df).collect()}


def blocks(page):
    return [text for _, text in read_page(page)[1]]


def test_reading_of_markup():
    assert blocks("<p>a <b>b</b>c&amp;d<br>e<p>f") == ["a bc&d e", "f"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert blocks("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert blocks("x < y <3 &lt;z&gt; &nbsp; &#233;&eacute;") == ["x < y <3 <z> éé"]
    assert blocks("<p>a<!-- <p>no</p> -->b<script>if (a<b) '</p>'</script>c<style>p{}</style>") == ["abc"]
    assert blocks("<title>t</title><p title='a>b'>c</p><div data-x=\"</div>\">d</div>") == ["c", "d"]
    assert blocks("<p>a</b></i></div>b</p>") == ["ab"]
    assert blocks("<p>kept<script>never closed </p><p>x") == ["kept"]
    assert blocks("a\n\t b\x0c c") == ["a b c"] and blocks("") == [] and blocks("   ") == []
    assert blocks("<P>A</P><Br/><DIV/>B") == ["A", "B"]
    assert blocks("<p>cut off <b") == ["cut off"]
    assert blocks("<p>a<span class='ad'>buy <b>now</b></span> b</p>") == ["a b"]


def test_hostile_markup_is_read_in_time():
    assert blocks("<div>" * 50_000 + "deep") == ["deep"]
    assert read_page("<div>" * 500 + "deep")[1][0][0].depth == DEPTH
    assert blocks("<b>" * 50_000 + "x" + "</i>" * 50_000 + "</p>" * 50_000) == ["x"]
    assert len(blocks("<p>word" * 100_000)) == 100_000
    assert blocks("<a href='" * 20_000 + "x")[-1:] is not None
    long = "word " * 400_000
    assert blocks(f"<p>{long}</p>") == [long.strip()]


def test_heaviest_choice_in_order():
    draw = random.Random(4)
    for _ in range(300):
        places = draw.sample(range(9), draw.randint(0, 7))
        pairs = [(p, draw.randint(1, 5)) for p in places]
        best = max(
            (sum(w for _, w in c) for k in range(len(pairs) + 1) for c in combinations(pairs, k) if [p for p, _ in c] == sorted(p for p, _ in c)),
        )
        chosen = [pairs[k] for k in _heaviest_in_order(pairs)]
        assert chosen == sorted(chosen) and sum(w for _, w in chosen) == best


def simple_tree_matching(a, b):
    """The recurrence itself, over two lists of children."""
    x, y = list(a.children.values()), list(b.children.values())
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            w = simple_tree_matching(x[i - 1], y[j - 1]) if x[i - 1].sig == y[j - 1].sig else 0
            m[i][j] = max(m[i][j - 1], m[i - 1][j], m[i - 1][j - 1] + w)
    return 1 + m[len(x)][len(y)]


def test_tree_matching_is_the_recurrence():
    draw = random.Random(9)

    def tree(depth):
        node = Node("#", depth)
        for sig in draw.sample("abcde", draw.randint(0, 4) if depth < 3 else 0):
            node.children[sig] = tree(depth + 1)
            node.children[sig].sig = sig
        return node

    for _ in range(200):
        a, b = tree(0), tree(0)
        assert TreeMatch().score(a, b) == simple_tree_matching(a, b)


def words(draw, n):
    return " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(n))


def layout(kind, title, paragraphs, draw):
    """A page of one of four layouts around the same article."""
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in words(draw, 6).split())
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    if kind == 0:
        return (f"<html><head><title>{title}</title></head><body><header><h2>{words(draw, 3)}</h2></header><nav><ul>{links}</ul></nav>"
                f"<article><header><h1>{title}</h1></header>{body}<aside>{words(draw, 9)}</aside><form><p>{words(draw, 4)}</p></form>"
                f"<section class='comments'><article><p>{words(draw, 20)}</p></article></section></article><footer>{words(draw, 5)}</footer></body></html>")
    if kind == 1:
        return (f"<body class='with-sidebar'><div class='topbar'>{words(draw, 4)}</div><ul>{links}</ul><div id='text'><h1>{title}</h1>{body}</div>"
                f"<div class='sidebar-left'><p>{words(draw, 12)}</p></div><div id='comments'><p>{words(draw, 30)}</p></div>"
                "<div><p>All rights reserved by the owner of this site.</p></div></body>")
    if kind == 2:
        return (f"<table><tr><td class='menu'>{links}<td><h1>{title}</h1>{body}<p class='cookie-notice'>{words(draw, 6)}</p>"
                "<tr><td colspan=2><div>Site run by volunteers</div></table>")
    return f"<main><h1>{title}</h1>{body}<div role='complementary'>{words(draw, 8)}</div></main><div>{words(draw, 8)}</div>"


def test_layouts_by_host(spark):
    draw = random.Random(6)
    pages, want = [], {}
    for k in range(4):
        for i in range(12):
            title, paragraphs = words(draw, 4), [words(draw, draw.choice([1, 8, 40])) for _ in range(draw.randint(1, 6))]
            key = 100 * k + i
            pages.append((key, f"https://Host{k}.example.org/{i}", layout(k, title, paragraphs, draw)))
            want[key] = "\n\n".join([title, *paragraphs])
    assert texts(spark, pages) == want
    # However the pages are dealt, and when templates are handed on early.
    assert texts(spark, pages, 1) == texts(spark, pages, 7) == want


def test_templates_handed_on_early(spark, monkeypatch):
    draw = random.Random(7)
    pages = [(i, "http://h/", layout(1, words(draw, 3), [words(draw, 30)], draw)) for i in range(30)]
    whole = [page_template(read_page(p)[0]) for *_, p in pages]
    first = whole[0]
    for tree in whole[1:]:
        pt.merge(first, tree)
    merged = pt.wrapper(first)
    again = [page_template(read_page(p)[0]) for *_, p in pages]
    left, right = again[0], again[15]
    for tree in again[1:15]:
        pt.merge(left, tree)
    for tree in again[16:]:
        pt.merge(right, tree)
    pt.merge(left, right)
    assert pt.wrapper(left) == merged == pt.wrapper(pt.unpacked(left.packed()))


def test_headers_of_pages_and_of_articles(spark):
    draw = random.Random(3)
    rest = "<div class='entry-header'><h1>{t}</h1></div><p>{p}</p>"
    heads = ["<header><p>{s}</p></header>", "<div id='header'>{s}</div>", "<div class='site-header'><b>{s}</b></div>"]
    pages, want = [], {}
    for k, head in enumerate(heads):
        for i in range(2):  # too few pages for a constant
            title, text = words(draw, 3), words(draw, 20)
            key = 10 * k + i
            pages.append((key, f"http://h{k}.example/", "<body>" + head.format(s=words(draw, 5)) + rest.format(t=title, p=text)))
            want[key] = f"{title}\n\n{text}"
    pages.append((90, "http://own.example/", "<article><header><h1>T</h1><p>by me</p></header><p>text of it</p></article>"))
    pages.append((91, "http://top.example/", "<body><header><h1>T</h1></header><p>text of it</p>"))
    want |= {90: "T\n\nby me\n\ntext of it", 91: "T\n\ntext of it"}
    assert texts(spark, pages) == want


def test_copies_do_not_become_template(spark):
    draw = random.Random(1)
    article = [words(draw, 30), words(draw, 20)]
    pages = [(i, "http://copies.example/", layout(1, "same title", article, draw)) for i in range(9)]
    pages += [(20 + i, "http://two.example/", layout(1, words(draw, 3), article, draw)) for i in range(2)]
    found = texts(spark, pages)
    assert all("\n\n".join(article) in found[p[0]] for p in pages)


def test_defined_results(spark):
    pages = [
        (1, None, None), (2, None, ""), (3, "no host", "<p>alone</p>"), (4, "http://one.example/x", "plain text only"),
        (None, "http://one.example/y", "<article><h1>A title of some length</h1></article><div>outside</div>"), (6, "http://e.example", "<nav>menu only</nav>"),
        (7, "http://rep.example", "<p>twice</p>"), (7, "http://rep.example", "<p>twice</p>"), (8, "http://l.example", "<p>" + "long " * 300_000),
    ]
    df = spark.createDataFrame([(*p, "x", "y", "z") for p in pages], SCHEMA)
    got = extract_text(df)
    assert got.columns == ["page_id", "url", "text"]
    rows = sorted(((r.page_id or 0, r.text) for r in got.collect()))
    assert rows[:4] == [(0, "A title of some length"), (1, ""), (2, ""), (3, "alone")]
    assert rows[4:8] == [(4, "plain text only"), (6, ""), (7, "twice"), (7, "twice")]
    assert rows[8] == (8, ("long " * 300_000).strip())
    assert extract_text(df.limit(0)).collect() == []


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_given_pages_give_their_articles(spark):
    pages = spark.read.parquet(str(DATA / "pages.parquet")).collect()
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op12_page_text"](spark, str(DATA)).collect()}
    assert len(got) == len(pages)
    for page in pages:
        article = re.search(r"(?s)<article>(.*?)</article>", page.html)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[a-z/]+>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", article)]
        want = "\n\n".join(x for x in parts if x)
        assert got[page.page_id] == (want, len(want))
