"""Quality rules, URL filter, licences and the pipeline on small tables."""

import math
import random
import re
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gauge_engine.llm.catalog import ORACLES, QUERIES
from gauge_engine.llm.licences import scan_licences
from gauge_engine.llm.quality import RULES, Rule, judge_quality, keep_quality, keeps, order_rules
from gauge_engine.llm.url_filter import ORDER, LikelihoodRatio, judge_urls
from gauge_engine.llm.url_filter import Rule as UrlRule

DATA = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute_metrics(text):
    words = WORD.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
    )


def test_quality_metrics_and_verdicts(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [
        None, "", " \x0b\x0c ", "a b", " ".join(words), " ".join(words[:12] * 2), "the " * 40, "é\u00a0x " + " ".join(words),
        "\n".join(words[:11]) + "\n" + "\n".join(words[:11]), " ".join(w + "***" for w in words), " ".join(w + "!!" for w in words),
        " ".join(words * 3 + ["q"] + words[:5]), "a b c d e a b c d e",
    ]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate([*texts, texts[4]])], "doc_id int, text string, n_words int, kept string")
    got = judge_quality(df).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_metrics(r.text), r
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {4, 7, len(texts)}
    left = keep_quality(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == kept
    assert judge_quality(df.limit(0)).count() == 0 and keep_quality(df.limit(0)).count() == 0


def test_the_order_of_rules_does_not_change_verdicts(spark):
    df = spark.createDataFrame([(i, "word " * i) for i in range(30)], "doc_id int, text string")
    for rules in (RULES, RULES[::-1], (Rule("nothing", lambda m: m["n_words"] < 0),)):
        want = 30 if len(rules) == 1 else 0
        assert keep_quality(df, rules).count() == want


def test_the_measured_order_is_stable(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(2, 9) for _ in range(rng.randint(5, 120))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(7)

    def slow_never(m):
        return (m["n_repeat_words"] < 0) | (m["n_dup_lines"] < 0)

    rules = (
        Rule("a_slow_never", slow_never), Rule("b_slow_all", lambda m: (m["n_repeat_words"] >= 0) & (m["n_words"] > 0)),
        Rule("c_quick_all", lambda m: m["n_words"] > 0), Rule("d_quick_few", lambda m: m["n_words"] < 6),
    )
    orders = {tuple(r.name for r in order_rules(df, rules)) for _ in range(3)}
    assert {o[0] for o in orders} == {"c_quick_all"} and {o[-1] for o in orders} == {"a_slow_never"}
    assert len(orders) == 1
    assert order_rules(df.limit(0), rules) == list(rules)
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert {r.name for r in order_rules(blank, rules)} == {r.name for r in rules}


def test_the_cascade_reads_metrics_where_it_needs_them(spark):
    """A rule behind one that has rejected is not evaluated: its metric would fail."""
    df = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id int, text string")
    rules = [Rule("all", lambda m: m["n_words"] > 0), Rule("fails", lambda m: F.raise_error(F.lit("evaluated")).cast("boolean"))]
    assert df.where(keeps(rules)).count() == 0
    with pytest.raises(Exception, match="evaluated"):
        df.where(keeps(rules[::-1])).count()


def test_url_parts_rules_and_verdicts(spark):
    rules = [UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/")]
    urls = [
        "http://A.Example.NET/en/1?x#y", "http://example.net/de/", "http://net", "https://x.example.com/de/?a", "http://q.org/fr/a://b/c",
        "http://myexample.com/de/", None, "", "no scheme", "http://h?q/de/", "a://b://c/d", "http://x.net/\nen#t",
    ]
    urls += [f"http://site{i}.example.net/en/page{i}" for i in range(40)] + [f"http://x{i}.net/buy-now-{i}" for i in range(40)]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate([*urls, urls[0]])], "page_id int, url string, host int")
    got = {r.page_id: r for r in judge_urls(df, rules).collect()}
    parts = [(r.host, r.path, r.rule) for _, r in sorted(got.items())][:12]
    assert parts == [
        ("a.example.net", "/en/1", "example.net/en/"), ("example.net", "/de/", "net/"), ("net", "", None),
        ("x.example.com", "/de/", "example.com/de/"), ("q.org", "/fr/a://b/c", "org/fr/"), ("myexample.com", "/de/", None),
        ("", "", None), ("", "", None), ("", "", None), ("h", "", None), ("b:", "//c/d", None), ("x.net", "/\nen", "net/"),
    ]
    assert got[0].verdict == "allow" and got[1].verdict == "block" and got[len(urls)].verdict == "allow"
    assert {r.verdict for r in got.values()} == {"allow", "block"}
    bare = judge_urls(df.where("page_id = 6"), rules).first()
    assert bare.verdict == "allow" and bare.score is None
    assert judge_urls(df.limit(0), rules).count() == 0


def test_likelihood_ratio_tells_held_out_urls_apart():
    good = [f"https://news{i}.example/en/story-{i * 7}" for i in range(300)]
    bad = [f"http://cheap{i}.example/buy/pills-{i * 3}" for i in range(300)]
    ratio = LikelihoodRatio(good[:200], bad[:200])
    ratio.calibrate(good[200:250], bad[200:250])
    hits = [ratio.score(u) >= ratio.threshold for u in good[250:]] + [ratio.score(u) < ratio.threshold for u in bad[250:]]
    assert sum(hits) / len(hits) >= 0.95


def test_licence_sentences_and_rules(spark):
    bsd = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    )
    texts = [
        "Licensed under the Apache License, Version 2.0.\nSome words.", "  RELEASED under the MIT license!  Then more.\nLicensed under CC BY-NC 4.0.",
        bsd, "\n".join(reversed(bsd.split("\n"))), "A licence is mentioned here only.", None, "", "This is not Licensed under CC BY 4.0.",
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id int, text string, licences int")
    got = {r.doc_id: r.licences for r in scan_licences(df).collect()}
    assert got == {0: ["Apache-2.0-notice"], 1: ["MIT-notice", "CC-BY-NC-4.0"], 2: ["BSD-2-Clause"], 3: [], 4: [], 5: [], 6: [], 7: []}
    assert scan_licences(df.limit(0)).count() == 0


def test_pipeline_stages_keep_and_drop(spark, tmp_path):
    rng = random.Random(1)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))

    item, body, clean, line = prose(40), prose(80), prose(60), prose(12)
    docs = [
        (1, clean), (2, "short"), (3, "junk " * 50), (4, body), (5, body), (6, " ".join(["new", *body.split()[1:]])),
        (7, f"{prose(20)} {item}"), (8, f"{line}\n{prose(30)}"), (9, f"{prose(30)}\n{line}"), (10, None), (None, prose(25)),
    ]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in docs]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    held = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, sf)
        assert held.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        held.write.parquet(f"{sf}/{name}")
        held = spark.read.parquet(f"{sf}/{name}")
        kept.append({r.doc_id for r in held.select("doc_id").collect()})
    assert kept[0] == {1, 4, 5, 6, 7, 8, 9, None}
    assert kept[1] == kept[0] - {5, 6} and held.where("doc_id = 9").first().text.count("\n") == 0
    assert kept[2] == kept[1] and kept[3] == kept[2] - {7}
    assert held.where("n_chars <> length(text)").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == kept[3]


def test_near_duplicates_go_with_and_without_ids(spark):
    rng = random.Random(3)
    words = [["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80)] for _ in range(3)]
    text, other, third = (" ".join(w) for w in words)
    near = " ".join(["new", *words[0][1:]])
    docs = [
        (5, text), (3, near), (7, text), (7, text), (None, text), (None, near), (8, other), (None, third), (None, third),
        (None, " ".join([*words[2][:-1], "end"])), (9, None), (10, ""), (None, None), (11, "a b"),
    ]
    rows = [(i, t, len(t or "")) for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    left = corpus_pipeline.near_duplicates(spark, df, "")
    assert left.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    found = [x for x in got if x[0] is None and x[1]]
    assert len(found) == 1 and found[0][1].startswith(" ".join(words[2][:-1]))
    assert [x for x in got if x not in found] == sorted([(3, near), (8, other), (9, None), (10, ""), (None, None), (11, "a b")], key=str)
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), "").count() == 0


def test_markov_models_equal_brute_force():
    """Smoothing, score and threshold by their definitions, from substring counts."""
    good = ["http://a.org/fr/x", "http://bb.org/fr/yy", "http://c.org/fr/zx"]
    bad = ["http://a.net/q", "http://dd.net/qq?9"]
    ratio = LikelihoodRatio(good, bad)

    def log_p(texts, text):
        padded = ["\x02" * ORDER + t + "\x03" for t in texts]

        def p(context, char):
            starts = [(t, i) for t in padded for i in range(ORDER, len(t)) if t[i - len(context) : i] == context]
            after = [t[i] for t, i in starts]
            shorter = 1 / 65_536 if not context else p(context[1:], char)
            return (after.count(char) + len(set(after)) * shorter) / (len(after) + len(set(after))) if after else shorter

        whole = "\x02" * ORDER + text + "\x03"
        return sum(math.log(p(whole[i - ORDER : i], whole[i])) for i in range(ORDER, len(whole)))

    asked = [*good, *bad, "", "é://ü", "http://e.org/fr/q", "http://e.net/x", "x" * 3_000]
    for text in asked:
        assert ratio.score(text) == pytest.approx((log_p(good, text) - log_p(bad, text)) / (len(text) + 1), abs=1e-9)
    accepted, rejected = asked[:3] + asked[7:8], asked[3:5] + asked[8:9]
    ratio.calibrate(accepted, rejected)

    def rate(cut):
        hits = [sum(keep(ratio.score(t)) for t in texts) / len(texts) for texts, keep in ((accepted, lambda x: x >= cut), (rejected, lambda x: x < cut))]
        return sum(hits)

    scores = sorted({ratio.score(t) for t in (*accepted, *rejected)})
    assert rate(ratio.threshold) == max(map(rate, [*scores, *[(a + b) / 2 for a, b in zip(scores, scores[1:])]]))


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_queries_are_listed(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    import oracle

    sf = str(DATA)
    assert oracle.differences(QUERIES[name](spark, sf), oracle.connect(sf), ORACLES[name]) == []
