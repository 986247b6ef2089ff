"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

import re

from gauge_engine.llm.licences import RULES, SENTENCES, normal_sentence

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"

OP2 = rf"""WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
smallest AS (SELECT x, min(y) AS c FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN smallest ON x = doc_id"""

OP5 = rf"""WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws, {_LINES} AS ls FROM documents),
g AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM twice) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations
  FROM w LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR 2 * n_exclamations > n_words
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept FROM b"""


def _licences_sql() -> str:
    """Sentence and line ends are written twice, as a match takes one on either side."""
    known = ", ".join(f"'{normal_sentence(x)}': '{name}'" for name, x in SENTENCES.items())
    ends, line = r"(?: [\x01\x02])* ", r"(?: \x02)* "
    sentences = []
    for sentence in sorted(SENTENCES.values(), key=lambda x: -len(normal_sentence(x))):
        pieces = [normal_sentence(p).split() for p in re.split(r"[.!?;:]\s+", sentence)]
        sentences.append(ends.join(line.join(words) for words in pieces if words))
    cases, earlier = [], {}
    for family, licence, ids in RULES:
        fits = "q LIKE '%" + "%".join(f"|{i}|" for i in ids) + "%'"
        blocked = " AND ".join(f"NOT ({e})" for e in earlier.get(family, []))
        cases.append(f"CASE WHEN {fits}{' AND ' + blocked if blocked else ''} THEN '{licence}' END")
        earlier.setdefault(family, []).append(fits)
    return rf"""WITH plain AS (SELECT doc_id, regexp_replace(
    translate(lower(coalesce(text, '')), chr(1) || chr(2), '  '), '\r\n?', chr(10), 'g') AS t FROM documents),
ended AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t,
    '[.!?;:][\x20\x09-\x0D]+', ' ' || chr(1) || ' ', 'g'),
    '\n[^\p{{L}}\p{{N}}\n]*\n', ' ' || chr(1) || ' ' || chr(10), 'g'), '\n', ' ' || chr(2) || ' ', 'g') AS t FROM plain),
marked AS (SELECT doc_id, ' ' || chr(1) || ' ' || trim(regexp_replace(regexp_replace(
    regexp_replace(t, '[^a-z0-9\x01\x02]+', ' ', 'g'), ' ?([\x01\x02]) ?', ' \1 \1 ', 'g'), ' +', ' ', 'g')) || ' ' || chr(1) AS t FROM ended),
s AS (SELECT doc_id, list_filter(list_transform(
    regexp_extract_all(t, '[\x01\x02] ({"|".join(sentences)}) [\x01\x02]', 1),
    lambda x: MAP {{{known}}}[regexp_replace(x, '[ \x01\x02]+', ' ', 'g')]), lambda x: x IS NOT NULL) AS ids FROM marked),
f AS (SELECT doc_id, ids, '|' || array_to_string(ids, '||') || '|' AS q FROM s)
SELECT doc_id, array_to_string(ids, ',') AS licence_sentences,
  array_to_string(list_filter([{", ".join(cases)}], lambda x: x IS NOT NULL), ',') AS licences FROM f"""


OP8 = _licences_sql()


# Terms are what is left between the separators; only A-Z are lower-cased.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP13 = f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM documents
), counted AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), lengths AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id
), corpus AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counted, corpus GROUP BY term, docs
), asked AS (
  SELECT DISTINCT item_id, term
  FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark)
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (doc_id), corpus
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP11 = """
WITH taken AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM taken a, taken r WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""
