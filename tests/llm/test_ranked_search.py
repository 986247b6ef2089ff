"""Ranked search against scores of every document, computed one by one."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import oracle
import pytest

from gauge_engine.llm import ranked_search
from gauge_engine.llm.catalog import ORACLES, QUERIES
from gauge_engine.llm.ranked_search import Best, Segment, search, terms_of

DATA = Path("/root/testdata/sf0.01")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, top=10):
    words = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    words = [(d, c) for d, c in words if c]
    n, total = len(words), sum(sum(c.values()) for _, c in words)
    df = Counter(w for _, c in words for w in c)
    found = set()
    for item, text in set(items):
        scored = []
        for d, c in words:
            m = 10 + (90 * sum(c.values()) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
                for w in set(TERM.findall((text or "").translate(LOWER))) if w in c
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        scored.sort(key=lambda s: s[:3])
        found |= {(item, k + 1, s[3], -s[0]) for k, s in enumerate(scored[:top])}
    return sorted(found)


def rows(df):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_terms_are_the_stated_pattern():
    for text in ["A b_c-D9 É", "", "\x00\x1c\x85x y", "ÄB\tc d", "x" * 100_000, "İK"]:
        assert [t.decode() for t in terms_of(text.encode())] == TERM.findall(text.translate(LOWER))


@pytest.mark.parametrize("postings", [40, 1 << 19])
def test_against_every_score(spark, monkeypatch, postings):
    monkeypatch.setattr(ranked_search, "SEGMENT_POSTINGS", postings)
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    odds = [1 / (i + 1) for i in range(60)]

    def text(k):
        return " ".join(draw.choices(vocabulary, odds, k=k))

    docs = [(i, text(draw.choice([1, 3, 20, 80]))) for i in draw.sample(range(10_000), 300)]
    docs += [(20_000 + i, docs[7][1]) for i in range(40)]  # copies: ties beyond the tenth place
    docs += [(30_000, None), (30_001, ""), (30_002, "  ,;- "), (30_003, "w1 " * 20_000), (docs[3]), (docs[3])]
    items = [(i, text(8)) for i in range(25)] + [(30, docs[7][1]), (31, None), (32, ""), (33, "absent words"), (34, "W1 w1 W59"), (34, "w2"), (30, docs[7][1])]
    table = spark.createDataFrame([(*d, 0, 1, "x") for d in docs], "doc_id bigint, text string, item_id int, rank int, score string").repartition(5)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows(search(table, asked)) == brute(docs, items)
    assert rows(search(table, asked, top=3, batch_bytes=100)) == brute(docs, items, 3)


def test_null_ids_rank_behind_equal_scores(spark):
    docs = [(None, "a b"), (5, "a b"), (4, "a b"), (None, "c")]
    items = [(1, "a"), (None, "c")]
    found = search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = sorted(((r.item_id or 0, r["rank"], r.doc_id) for r in found.collect()), key=repr)
    assert got == sorted([(1, 1, 4), (1, 2, 5), (1, 3, None), (0, 1, None)], key=repr)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    assert search(docs, items).collect() == []
    assert search(some, items).collect() == []
    assert search(docs, some.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_range_maxima():
    draw = np.random.default_rng(1)
    held = np.array([50, 1, 17])
    doc = np.concatenate([np.sort(draw.choice(60, h, replace=False)) for h in held])
    tf = draw.integers(1, 9, len(doc))
    segment = Segment(np.arange(60), draw.integers(1, 99, 60), np.array([2, 5, 9]), held, doc, tf, 60, 3000)
    for _ in range(300):
        k = draw.integers(3)
        a, b = np.sort(draw.integers(segment.starts[k], segment.ends[k] + 1, 2))
        peak = segment.maxima(np.array([a]), np.array([b]))[0]
        own = segment.impact[a:b]
        assert (peak >> 32) == (own.max() if len(own) else 0)
        if len(own):
            assert 0xFFFFFFFF - (peak & 0xFFFFFFFF) == a + own.argmax()


def test_search_looks_at_few_documents(monkeypatch):
    """A rare, heavy term leaves most of the intervals unopened."""
    n = 4000
    doc = np.concatenate([np.arange(n), np.arange(0, n, 400)])
    held = np.array([n, 10])
    segment = Segment(np.arange(n), np.full(n, 50), np.array([0, 1]), held, doc, np.ones(len(doc), "i8"), n, 50 * n)
    scored = []
    add = Best.add
    monkeypatch.setattr(Best, "add", lambda self, s, i: (scored.append(len(s)), add(self, s, i)))
    best = Best(10)
    ranked_search.best_first(segment, {0: 10, 1: 5000}, best)
    assert best.ids.tolist() == list(range(0, n, 400))
    assert sum(scored) < 200


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_matches_sql(spark):
    con = oracle.connect(str(DATA))
    assert oracle.differences(QUERIES["op13_ranked_search"](spark, str(DATA)), con, ORACLES["op13_ranked_search"]) == []
