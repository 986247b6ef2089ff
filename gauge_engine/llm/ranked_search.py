"""Ranked lexical search: range maxima over posting lists bound what a document interval can score.

Items are the queries, documents are ranked for each of them. A term is a maximal run of
ASCII letters, ASCII digits and characters beyond ASCII; only A-Z are lower-cased.

1. Every task turns its documents into segments: documents in ascending id order, and for
   each term of an item the list of documents that hold it (postings). Texts are not moved.
2. Term statistics are summed over the segments, so they cover all documents.
3. In a segment each posting list gets a sparse table, which answers the largest impact in any
   range of the list from two look-ups. The search starts from the whole segment as one
   interval. The sum of an item's range maxima bounds every score in an interval. The
   intervals with the highest bounds are split at the document of the largest single impact,
   which is scored exactly; the rest of the interval goes on as two intervals. Intervals
   whose bound cannot enter the item's best documents are left.

The best documents of an item carry over from segment to segment of a task; a last window
merges the tasks' lists, of at most ``top`` rows per item and task.

Scores are whole numbers: see ``search``. Documents without terms are neither counted nor
found. Null ids come after all others among equal scores. Repeated rows count separately;
repeated items (equal id and text) count once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gauge_engine.llm.exchange import pack_sums, unpack_sums
from gauge_engine.llm.shipping import ship_package
from gauge_engine.session import materialize

# Items are worked on in batches of about this much text; the terms of one batch travel with
# the tasks, so this bounds what the driver and a task hold of the items.
BATCH_BYTES = 4 << 20
# Postings of a segment; its sparse tables take about 8 bytes times the logarithm of the
# longest list for each.
SEGMENT_POSTINGS = 1 << 19
# Intervals split at once, at most.
WIDTH = 512

NO_ID = np.iinfo("i8").max

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

_INDEX = (
    "docs bigint, terms bigint, codes array<int>, held array<int>, ids binary, lengths binary, doc binary, tf binary"
)
_FOUND = "item int, doc_id bigint, score bigint"


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_FOLD).split()


def _segments(batches: Iterator[pa.RecordBatch], code: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Documents (id, text) to rows of ``_INDEX``."""
    schema = pa.schema(
        [("docs", pa.int64()), ("terms", pa.int64()), ("codes", pa.list_(pa.int32())), ("held", pa.list_(pa.int32()))]
        + [(c, pa.binary()) for c in ("ids", "lengths", "doc", "tf")]
    )
    ids, lengths, found, docs, total, held = [], [], [], 0, 0, 0

    def flush() -> pa.RecordBatch:
        keys = np.array([NO_ID if i is None else i for i in ids], "i8")
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(keys), "i8")
        place[order] = np.arange(len(keys))
        sizes = [len(f) for f in found]
        doc = np.repeat(place, sizes)
        codes = np.fromiter((c for f in found for c in f), "i8", sum(sizes))
        tf = np.fromiter((n for f in found for n in f.values()), "i8", len(codes))
        by = np.lexsort((doc, codes))
        each, counts = np.unique(codes, return_counts=True)
        packed = (keys[order].astype("<i8").tobytes(), pack_sums(np.array(lengths, "i8")[order]), pack_sums(doc[by]), pack_sums(tf[by]))
        row = [[docs], [total], [each.tolist()], [counts.tolist()], *[[p] for p in packed]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = terms_of(text) if text else None
            if not words:
                continue
            docs += 1
            total += len(words)
            counted = Counter(map(code.get, words))
            counted.pop(None, None)
            if counted:
                ids.append(key)
                lengths.append(len(words))
                found.append(counted)
                held += len(counted)
            if held >= SEGMENT_POSTINGS:
                yield flush()
                ids, lengths, found, docs, total, held = [], [], [], 0, 0, 0
    if docs:
        yield flush()


class Segment:
    """Posting lists of one segment with a sparse table over each of them.

    ``starts`` and ``ends`` bound the list of every code, ``keys`` are ``code * n + document``
    in ascending order, ``tops`` holds for level k and posting p the largest of the 2^k
    impacts from p on, with its posting in the lower 32 bits (the first of equal ones wins).
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, held: np.ndarray,
                 doc: np.ndarray, tf: np.ndarray, docs: int, terms: int) -> None:
        self.ids, self.doc, self.n = ids, doc, len(ids)
        self.ends = np.cumsum(held)
        self.starts = self.ends - held
        self.slot = {int(c): k for k, c in enumerate(codes)}
        self.keys = np.repeat(np.arange(len(codes)), held) * self.n + doc
        spread = 10 + (90 * lengths * docs) // terms
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * spread[doc])
        level = (self.impact << 32) | (0xFFFFFFFF - np.arange(len(doc)))
        self.tops = [level]
        for k in range(int(held.max(initial=1)).bit_length() - 1):
            step, grown = 1 << k, level.copy()
            np.maximum(level[:-step], level[step:], out=grown[:-step])
            level = grown
            self.tops.append(level)
        self.tops = np.stack(self.tops)

    def maxima(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Largest impact and its posting in every range; 0 for empty ones."""
        width = high - low
        some = width > 0
        level = np.zeros(width.shape, "i8")
        level[some] = np.frexp(width[some])[1] - 1
        left = np.where(some, low, 0)
        right = np.where(some, high - (1 << level), 0)
        return np.where(some, np.maximum(self.tops[level, left], self.tops[level, right]), 0)


class Best:
    """The ``top`` best (score, id) of one item, equal scores by ascending id."""

    def __init__(self, top: int) -> None:
        self.top, self.scores, self.ids = top, np.empty(0, "i8"), np.empty(0, "i8")

    def admits(self, bound: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a score of ``bound`` at the id ``first`` would enter."""
        if len(self.scores) < self.top:
            return bound > 0
        return (bound > self.scores[-1]) | ((bound == self.scores[-1]) & (first < self.ids[-1]))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids[order]


def best_first(segment: Segment, weights: dict[int, int], best: Best) -> None:
    """Add to ``best`` what the segment holds for an item of these term weights."""
    slots = np.array([segment.slot[c] for c in weights if c in segment.slot], "i8")
    if not len(slots):
        return
    weight = np.array([w for c, w in weights.items() if c in segment.slot], "i8")
    base = slots * segment.n

    def bounded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """The intervals that can still enter, with their maxima and bounds."""
        peaks = segment.maxima(low, high)
        bound = (peaks >> 32) @ weight
        held = high > low
        first = np.where(held, segment.doc[np.where(held, low, 0)], segment.n).min(axis=1)
        go_on = best.admits(bound, segment.ids[np.minimum(first, segment.n - 1)]) & (first < segment.n)
        return low[go_on], high[go_on], peaks[go_on], bound[go_on], first[go_on]

    front = bounded(segment.starts[slots][None], segment.ends[slots][None])
    width = 16
    while len(front[0]):
        order = np.argsort(-front[3], kind="stable")
        low, high, peaks = (part[order[:width]] for part in front[:3])
        rest = [part[order[width:]] for part in front]
        width = min(2 * width, WIDTH)
        # Split at the document of the largest weighted impact.
        term = ((peaks >> 32) * weight).argmax(axis=1)
        posting = 0xFFFFFFFF - (peaks[np.arange(len(term)), term] & 0xFFFFFFFF)
        doc = segment.doc[posting]
        wanted = base + doc[:, None]
        cut = np.searchsorted(segment.keys, wanted)
        hit = segment.keys[np.minimum(cut, len(segment.keys) - 1)] == wanted
        hit &= cut < len(segment.keys)
        scores = (np.where(hit, segment.impact[np.where(hit, cut, 0)], 0)) @ weight
        ids = segment.ids[doc]
        enters = best.admits(scores, ids)
        best.add(scores[enters], ids[enters])
        new = bounded(np.concatenate([low, cut + hit]), np.concatenate([cut, high]))
        stay = best.admits(rest[3], segment.ids[rest[4]])
        front = tuple(np.concatenate([a[stay], b]) for a, b in zip(rest, new))


def _search_batch(docs: DataFrame, items: list[tuple], top: int, label: str) -> DataFrame:
    """``item`` (position in ``items``), ``doc_id``, ``score`` of the best of every task."""
    wanted = [sorted(set(terms_of((text or "").encode()))) for _, text in items]
    code = {t: k for k, t in enumerate(sorted({t for own in wanted for t in own}))}
    spark = docs.sparkSession
    broadcast_code = spark.sparkContext.broadcast(code)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _segments(batches, broadcast_code.value)

    index = materialize(docs.mapInArrow(build, _INDEX), label)
    n, total = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    entry = F.explode(F.arrays_zip("codes", "held")).alias("e")
    held = index.select(entry).groupBy("e.codes").agg(F.sum("e.held").alias("df")).collect()
    weight = {c: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for c, df in held}
    queries = [{code[t]: weight[code[t]] for t in own if code[t] in weight} for own in wanted]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [Best(top) for _ in queries]
        for frame in frames:
            for row in frame.itertuples(index=False):
                if not len(row.codes):
                    continue
                segment = Segment(
                    np.frombuffer(row.ids, "<i8"), unpack_sums(row.lengths), np.asarray(row.codes, "i8"),
                    np.asarray(row.held, "i8"), unpack_sums(row.doc), unpack_sums(row.tf), n, total,
                )
                for query, best in zip(queries, found):
                    best_first(segment, query, best)
        for k, best in enumerate(found):
            ids = pd.array(best.ids, dtype="Int64")
            ids[best.ids == NO_ID] = pd.NA
            yield pd.DataFrame({"item": np.full(len(ids), k, "i4"), "doc_id": ids, "score": best.scores})

    return index.mapInPandas(search, _FOUND)


def search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents above 0 of each item.

    With N documents that have terms, L terms in all of them, n in one, df documents holding a
    term, tf its occurrences: weight = floor(1000 ln((2N + 2) / (2df + 1))), m = 10 +
    (90 n N) div L, score = sum over an item's distinct terms of
    weight * ((10^9 tf) div (1000 tf + 8 m)). Ties go to the smaller id, null ids last.

    Items of a null or empty text and items that share no term with any document have no row;
    empty tables give none. Items of equal id and different text are ranked each for itself.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary"))
    asked = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = 1 + size // batch_bytes
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(batches))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    result = None
    for k in range(batches):
        rows = [tuple(r) for r in asked.where(part == k).distinct().collect()]
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        ranked = (
            _search_batch(texts, rows, top, f"postings-{k}")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        )
        names = spark.createDataFrame([(j, r[0]) for j, r in enumerate(rows)], "item int, item_id bigint")
        done = ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        result = done if result is None else result.unionAll(done)
    return result
