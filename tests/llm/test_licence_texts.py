"""Every licence rule on its own text: plain, wrapped, and as a commented header."""

import textwrap

import duckdb

from gauge_engine.llm.catalog import ORACLES
from gauge_engine.llm.licences import RULES, SENTENCES, scan_licences


def by_sql(rows):
    """What the SQL counterpart finds in the same texts."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return {i: (x.split(",") if x else [], y.split(",") if y else []) for i, x, y in con.execute(ORACLES["op8_licences"]).fetchall()}


def test_every_rule_fires_on_its_own_text(spark):
    rows, want = [], []
    for _, licence, ids in RULES:
        # A sentence without a mark at its end closes its paragraph.
        text = "".join(s + (" " if s[-1] in ".:;" else "\n\n") for s in map(SENTENCES.get, ids))
        lines = [x for p in text.split("\n\n") for x in (*textwrap.wrap(p, 48), "")]
        shapes = [
            text, "\n".join(SENTENCES[i] for i in ids), "\n\n".join(SENTENCES[i] for i in ids), "\n".join(lines), "\r\n".join(lines),
            "".join(f"# {x}\n" for x in ["Copyright the authors", "", *lines]), "/*\n" + "".join(f" * {x}\n" for x in lines) + " */\nint x;",
            "A heading without an end\n" + "\n".join(lines) + "\nmore words",
        ]
        rows += [(len(rows) + k, s) for k, s in enumerate(shapes)]
        want += [(licence, list(ids))] * len(shapes)
    got = {r.doc_id: r for r in scan_licences(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    sql = by_sql(rows)
    for (i, text), (licence, ids) in zip(rows, want):
        assert sql[i] == (ids, [licence]), (licence, text, sql[i])
        assert got[i].licences == [licence] and got[i].licence_sentences == ids, (licence, text, got[i].licences)


def test_an_empty_line_and_other_words_keep_sentences_apart(spark):
    whole = SENTENCES["mit-notice"]
    broken = whole.replace("permission notice ", "permission notice\n\n")
    rows = [(0, broken), (1, broken.replace("\n\n", "\n#\n# ")), (2, f"Not {whole}"), (3, f"{whole[:-1]} or not."), (4, whole.replace(" notice ", " notice\n", 1))]
    got = {r.doc_id: r.licence_sentences for r in scan_licences(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [], 4: ["mit-notice"]}
    assert {i: found for i, (found, _) in by_sql([*rows, (5, None), (6, "")]).items()} == {**got, 5: [], 6: []}
