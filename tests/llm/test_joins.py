"""Pairwise operators against brute force on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from gauge_engine.llm.components import connected_components
from gauge_engine.llm.decontamination import drop_leaks, find_leaks
from gauge_engine.llm.exchange import pack_keys, pack_sums, unpack_keys, unpack_sums
from gauge_engine.llm.line_dedup import dedup_lines
from gauge_engine.llm.ngram_join import ngram_components
from gauge_engine.llm.suffix_dedup import maximal_repeats, remove_repeats
from gauge_engine.llm.suffix_tree import suffix_tree_scores

SCHEMA = "doc_id long, text string, key int, id int, component int"
WORDS = [a + b for a in ("an", "be", "ci", "do", "el") for b in ("ra", "ne", "mi", "to", "lu", "sk")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "x" + rng.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [prose(rng, rng.randint(12, 200)) for _ in range(25)]
    base = prose(rng, 120)
    out += [changed(rng, base, rng.randint(0, 3)) for _ in range(40)]
    out += [out[0]] * 5 + [out[1].upper(), "", " \n ", "one", "one two", "One  Two", "the " * 300]
    out += [out[2] + " " + out[3], out[2][:90] + " " + out[4], None]
    ids = list(range(len(out)))
    rng.shuffle(ids)
    return [(i, t, 1, 2, 3) for i, t in zip(ids, out)]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_components_match_brute_force(spark, rows, size, percent):
    sets = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.id: (r.n_shingles, r.component) for r in ngram_components(table(spark, rows), size, percent).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_components_of_rows_without_id_and_of_repeated_rows(spark, rows):
    text = rows[0][1] or rows[1][1]
    more = [(None, text, 0, 0, 0), (7, text, 0, 0, 0), (7, text, 0, 0, 0), (9, text, 0, 0, 0)]
    got = sorted(((r.id, r.component) for r in ngram_components(table(spark, more)).collect()), key=str)
    assert got == [(7, 7), (7, 7), (9, 7), (None, None)]
    assert ngram_components(table(spark, rows).limit(0)).count() == 0


def test_connected_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(300, 299), (5, 5), (299, 300)]
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {(i, 0) for i in range(41)} | {(k, 100) for k in range(100, 140)} | {(299, 299), (300, 299)}


@pytest.mark.parametrize("hot", [2, 5000])
def test_repeats_are_removed_byte_by_byte(spark, rows, hot):
    def order(i):
        return (i is None, i)

    more = [*rows, (None, rows[3][1], 0, 0, 0), (4000, "é" * 70, 0, 0, 0), (4001, "a" + "é" * 60, 0, 0, 0), (4001, "é" * 64, 0, 0, 0)]
    least = {}
    for i, text, *_ in more:
        b = (text or "").encode()
        for k in range(len(b) - 49):
            least[b[k : k + 50]] = min(least.get(b[k : k + 50], i), i, key=order)
    want = []
    for i, text, *_ in more:
        b = (text or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if order(least[b[k : k + 50]]) < order(i):
                gone[k : k + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(b), spans, hashlib.sha256(kept).hexdigest()))
    found = remove_repeats(table(spark, more), hot_documents=hot).collect()
    got = [(r.id, r.n_bytes, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert remove_repeats(table(spark, rows).limit(0)).count() == 0


def test_maximal_repeats_of_a_string():
    text = b"xabcyabczabc"
    suffixes = sorted(range(len(text)), key=lambda i: text[i:])

    def common(a, b):
        return next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or not text[a + k : a + k + 1]))

    lcp = [0, *[common(a, b) for a, b in zip(suffixes, suffixes[1:])], 0]
    left = [text[i - 1] if i else -1 for i in suffixes]
    got = {(n, text[suffixes[a] : suffixes[a] + n], b - a + 1) for n, a, b in maximal_repeats(lcp, left, 2)}
    assert got == {(3, b"abc", 3)}


def test_suffix_tree_scores_match_brute_force(spark):
    rng = random.Random(3)
    phrase = prose(rng, 30)
    rows = [(i, f"{prose(rng, 20)} {phrase} {prose(rng, 5)}", 0, 0, 0) for i in range(60)]
    rows += [(100, None, 0, 0, 0), (101, "", 0, 0, 0), (None, phrase, 0, 0, 0), (5, rows[5][1], 0, 0, 0)]
    least, divergence, smooth = 16, 0.02, 4.0
    texts = [(i, [*(t or "").encode().lower().split(), None]) for i, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in texts]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for (_, t), out in zip(texts, held):
        if not out:
            c1.update(t)
            c2.update(zip(t, t[1:]))
            c3.update(zip(t, t[1:], t[2:]))
    n, v = sum(c1.values()), len(c1)

    def root(w):
        return (c1[w] + 0.5) / (n + 0.5 * (v + 1))

    gain = defaultdict(float)
    for (a, b), k in c2.items():
        gain[a,] += k * math.log((k - 1 + smooth * root(b)) / ((c1[a] - 1 + smooth) * root(b)))
    for (a, b, c), k in c3.items():
        p = (c2[b, c] - 1 + smooth * root(c)) / (c1[b] - 1 + smooth)
        gain[a, b] += k * math.log((k - 1 + smooth * p) / ((c2[a, b] - 1 + smooth) * p))
    want = []
    for (i, t), out in zip(texts, held):
        base = score = 0.0
        for k, w in enumerate(t):
            p = root(w)
            base += math.log10(p)
            for depth, counts, of in ((1, c2, c1), (2, c3, c2)):
                if k >= depth:
                    context = tuple(t[k - depth : k])
                    times = of[context if depth == 2 else context[0]]
                    if times >= least and gain[context] >= divergence * times:
                        p = (counts[*context, w] + smooth * p) / (times + smooth)
            score += math.log10(p)
        want.append((str(i), out, len(t), sum(c1[w] > 0 for w in t), n, round(base, 6), round(score, 6)))
    found = suffix_tree_scores(table(spark, rows)).collect()
    got = [(str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found]
    assert sorted(got) == sorted(want)
    assert sum(w[6] for w in want if w[1]) > sum(w[5] for w in want if w[1])
    assert suffix_tree_scores(table(spark, rows).limit(0)).count() == 0


def test_leaks_survive_replaced_words(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, 40)) for i in range(5)] + [(9, "too short"), (10, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    every = items[1][1].split()
    every[7::9] = ["other"] * len(every[7::9])
    docs = [
        (0, f"{prose(rng, 30)} {items[0][1]} {prose(rng, 9)}", 0, 0, 0),
        (1, f"{prose(rng, 30)} {' '.join(every)} {prose(rng, 9)}", 0, 0, 0),
        (2, prose(rng, 300), 0, 0, 0), (3, "too short", 0, 0, 0), (4, None, 0, 0, 0), (5, "", 0, 0, 0),
        (None, items[2][1].upper().replace(" ", ", "), 0, 0, 0), (0, f"{prose(rng, 3)}", 0, 0, 0),
    ]
    docs.append(docs[0])
    df = table(spark, docs)
    got = find_leaks(df, benchmark)
    assert sorted(((r.id, r.item) for r in got.collect()), key=str) == [(0, 0), (1, 1), (None, 2)]
    left = drop_leaks(df, benchmark)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(
        ((r[0], r[1]) for r in docs[2:6] + docs[7:8]), key=str
    )
    assert find_leaks(df.limit(0), benchmark).count() == 0 and find_leaks(df, benchmark.limit(0)).count() == 0


def test_line_dedup_keeps_the_first_of_each_group(spark):
    rng = random.Random(2)
    line, other, long = prose(rng, 8), prose(rng, 12), prose(rng, 400)
    docs = [
        (3, f"{line}\n{other}\n\n--\nshort", 0, 0, 0),
        (1, f"{prose(rng, 9)}\n{line.upper()}!\nshort", 0, 0, 0),
        (2, f"{long}\n{prose(rng, 7)}", 0, 0, 0),
        (4, f"{long[:-1]}q\n{other}\n{other}", 0, 0, 0),
        (5, None, 0, 0, 0), (6, "", 0, 0, 0), (None, other, 0, 0, 0), (8, "\n", 0, 0, 0),
    ]
    docs.append(docs[2])
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(table(spark, docs)).collect()}
    assert got[3] == (f"{other}\n\n--", 5, 2)
    assert got[1] == (docs[1][1], 3, 0) and got[2] == (docs[2][1], 2, 0)
    assert got[4] == ("", 3, 3) and got[5] == (None, 0, 0) and got[6] == ("", 1, 0)
    assert got[None] == ("", 1, 1) and got[8] == ("\n", 2, 0)
    assert dedup_lines(table(spark, docs)).count() == len(docs)
    assert dedup_lines(table(spark, docs).limit(0)).count() == 0


def test_packed_keys_and_sums_round_trip():
    import numpy as np

    for keys in ([], [7], [7, 7], [0, 1, 2**64 - 1], [5, 300, 70000]):
        held = np.array(keys, np.uint64)
        assert unpack_keys(pack_keys(held)).tolist() == keys
    for sums in ([], [0, 255], [256], [2**40]):
        assert unpack_sums(pack_sums(np.array(sums, "i8"))).tolist() == sums
    assert unpack_sums(pack_sums(np.array([0.5, -1.0]))).tolist() == [0.5, -1.0]


def test_repeated_rows_lose_each_line_once(spark):
    """Three copies of a row whose two lines stand in an older one."""
    rng = random.Random(6)
    text = f"{prose(rng, 8)}\n{prose(rng, 11)}"
    docs = [(0, text, 0, 0, 0), *[(1, text, 0, 0, 0)] * 3]
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(table(spark, docs)).collect())
    assert got == [(0, text, 2, 0), *[(1, "", 2, 2)] * 3]
