"""Decontamination against brute force: masks, short items, starts, ties and long texts."""

import random
from itertools import combinations

import pytest

from gauge_engine.llm.decontamination import (
    LEAST_SPACED, MOST_SHORT, PERCENT, SHORTEST, STRETCH, drop_leaks, find_leaks, masks_for, sized,
)


def share_met(n, replaced):
    """Share of the ways to replace words of an item of n words that some mask still meets."""
    fits = []
    for mask in masks_for(n):
        marked = [i for i, m in enumerate(mask) if m == "1"]
        fits += [{p + i for i in marked} for p in range(n - len(mask) + 1)]
    ways = list(combinations(range(n), replaced))
    return sum(any(not f & set(w) for f in fits) for w in ways) / len(ways)


@pytest.mark.parametrize("n", range(SHORTEST, STRETCH + 2))
def test_masks_meet_items_of_every_length(n):
    most = 0 if n < LEAST_SPACED else min(n, STRETCH) * (100 - PERCENT) // 100
    least = 1.0 if n <= MOST_SHORT else 0.97
    assert all(share_met(n, replaced) >= least for replaced in range(most + 1))


def brute(doc, item):
    """(start, matched, stretch) of the best alignment, the first of equally good ones."""
    n = len(item)
    stretch = min(n, STRETCH)
    best = None
    for shift in range(-n + 1, len(doc)):
        same = [0 <= i + shift < len(doc) and doc[i + shift] == w for i, w in enumerate(item)]
        for i in range(n - stretch + 1):
            matched = sum(same[i : i + stretch])
            if 100 * matched >= (100 if n < LEAST_SPACED else PERCENT) * stretch:
                found = (matched, -(i + shift))
                best = max(best or found, found)
    return best and (max(-best[1], 0), best[0], stretch)


def test_found_passages_equal_brute_force(spark):
    rng = random.Random(5)

    def prose(n):
        return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]

    items = {n: prose(n) for n in (*range(SHORTEST, 19), 40)}
    docs = []
    for n, item in items.items():
        most = 0 if n < LEAST_SPACED else min(n, STRETCH) * (100 - PERCENT) // 100
        for replaced in range(most + 2):
            held = list(item)
            for i in rng.sample(range(n), replaced):
                held[i] = "other"
            docs += [prose(rng.randint(0, 9)) + held + prose(rng.randint(0, 9)), held]
        # Twice, and cut off at either end.
        docs += [item + prose(3) + item, item[1:] + prose(4), prose(4) + item[:-1]]
    docs.append(prose(30_000) + items[7] + prose(30_000) + items[40][5:30] + prose(10))
    # The same stretch at two places of an item.
    items[90] = items[16] + prose(2) + items[16]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = find_leaks(
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string"),
    ).collect()
    got = {(r.id, r.item): (r.start, r.matched, r.stretch) for r in got}
    # The long text is compared where it holds something.
    long = len(docs) - 1
    want = {(i, n): brute(d, x) for i, d in enumerate(docs[:long]) for n, x in items.items()}
    want = {k: v for k, v in want.items() if v}
    want |= {(long, 7): (30_000, 7, 7), (long, 40): (60_007, 16, 16)}
    assert got.keys() <= want.keys()
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert len(want) - len(got) <= 0.05 * len(want)
    assert all(k in got for k, v in want.items() if v[1] == v[2] or v[2] <= MOST_SHORT)


def test_items_without_an_id_and_of_one_id(spark):
    text = [f"w{i} x{i} y{i} z{i} q{i} r{i}" for i in range(4)]
    docs = spark.createDataFrame([(i, f"a {t} b", 0) for i, t in enumerate(text)], "doc_id int, text string, item int")
    items = spark.createDataFrame([(None, text[0]), (1, text[1]), (1, text[2]), (2, "w3 x3 y3 z3")], "item_id int, text string")
    got = find_leaks(docs, items).collect()
    assert sorted((r.id, r.item) for r in got if r.item) == [(1, 1), (2, 1)] and [r.id for r in got if r.item is None] == [0]
    assert [r.doc_id for r in drop_leaks(docs, items).collect()] == [3]
    assert find_leaks(docs, items.limit(0)).count() == 0


def test_wide_rows_are_not_broadcast(spark):
    wide = spark.range(40).selectExpr("id", "sequence(1, 200000) AS words")
    assert "broadcast" not in sized(wide, "words")._jdf.queryExecution().toString().lower()
    assert "broadcast" in sized(wide.limit(2), "words")._jdf.queryExecution().toString().lower()
