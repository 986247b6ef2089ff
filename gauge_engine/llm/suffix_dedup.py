"""Removal of long byte strings that documents share, with suffix arrays around anchors.

A string of ``length`` bytes holds ``length - GRAM + 1`` grams of ``GRAM`` bytes. Its
anchors are the grams with the smallest hash, so equal strings have equal anchors at equal
places, wherever they stand. Anchors that two documents share are found by sums per gram
(``exchange``). Around each of those, a context reaches as far as any string of ``length``
bytes over that anchor. Contexts of one gram meet in one task, each distinct one once per
bucket with the smallest document that has it. They meet as hashes first: that settles
equal contexts, and only grams with different contexts send their bytes.

There the suffixes of the contexts are sorted. A scan of the sorted suffixes with a stack
walks the tree of common-prefix intervals; an interval whose occurrences differ in the
byte to their left is a maximal repeat, and comes out with all its occurrences. A context
learns which of its strings also stand in a smaller document than the smallest of its own.
The buckets then mark their bytes.

A gram in more than ``hot_documents`` documents may have contexts without bound. Its
strings travel one by one instead, each as the only string of its context: equal ones
collapse in every bucket, and no task gets more than one per bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauge_engine.llm.exchange import (
    PIECES,
    bucket_count,
    bucketed,
    look_up,
    lookup_table,
    no_pieces,
    pack_keys,
    pieces,
    range_count,
    ranges,
    totals,
    unpack_keys,
)
from gauge_engine.llm.shipping import ship_package

GRAM = 25
LENGTH = 50
# Strings over one anchor start at most this far before it.
REACH = LENGTH - GRAM
WIDTH = REACH + LENGTH
HOT_DOCUMENTS = 5_000
SLICE = 1 << 17
# Contexts whose suffixes are sorted together, plus those of one more gram.
TOGETHER = 8_000

HASHED = "bucket bigint, part int, keys binary, hashes binary, least binary, repeated binary"
EQUAL = "bucket bigint, hashes binary, least binary, flags binary"
CONTEXTS = "bucket bigint, part int, keys binary, contexts binary, least binary"
COVERED = "bucket bigint, hashes binary, masks binary"
KEPT = "id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"

_NO_ID = np.iinfo(np.int64).max
_B = 0x9E3779B97F4A7C15
_DIVERSE = -1
# What is known of a context: several documents have it; its gram has other contexts.
_SEVERAL, _OTHERS = 1, 2


def _powers(n: int) -> np.uint64:
    return np.uint64(pow(_B, n, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_B))


class Bucket:
    """The texts of a bucket in one buffer, with zeros between them."""

    def __init__(self, frame: pd.DataFrame):
        texts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in frame["text"]]
        self.sizes = np.fromiter(map(len, texts), "i8", len(texts))
        gap = b"\0" * LENGTH
        self.bytes = np.frombuffer(gap + gap.join(texts) + gap, "u1")
        self.starts = LENGTH + np.cumsum(np.concatenate([[0], self.sizes[:-1] + LENGTH]))
        self.ids = frame["id"].astype("Int64").fillna(_NO_ID).to_numpy("i8")

    def _anchors_of(self, a: int, b: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors of the strings that start from ``a`` to ``b``; ``room``: bytes left in the text."""
        grams = LENGTH - GRAM + 1
        h1 = _BYTES[self.bytes[a : b + LENGTH - 1]]
        h2 = h1[:-1] * _powers(1) + h1[1:]
        h4 = h2[:-2] * _powers(2) + h2[2:]
        h8 = h4[:-4] * _powers(4) + h4[4:]
        h16 = h8[:-8] * _powers(8) + h8[8:]
        h24 = h16[: len(h8) - 16] * _powers(8) + h8[16:]
        h = _mixed(h24[: len(h1) - 24] * _powers(1) + h1[24:])
        low = h
        for step in (1, 2, 4, 8):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[: len(h) - grams + 1], low[grams - 16 :])
        low = np.where(room >= LENGTH, low, np.uint64(0))
        edge = np.zeros(grams - 1, np.uint64)
        high = np.concatenate([edge, low, edge])
        for step in (1, 2, 4, 8):
            high = np.maximum(high[:-step], high[step:])
        high = np.maximum(high[: len(h)], high[grams - 16 :])
        at = np.flatnonzero((high == h) & (h != 0))
        return a + at, h[at]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the buffer, gram hash and document of each anchor."""
        ends = self.starts + self.sizes
        places, keys = [], []
        for a in range(0, len(self.bytes) - LENGTH + 1, SLICE):
            b = min(a + SLICE, len(self.bytes) - LENGTH + 1)
            here = np.arange(a, b)
            doc = np.searchsorted(self.starts, here, "right") - 1
            room = np.where(doc >= 0, ends[doc] - here, 0)
            place, key = self._anchors_of(a, b, room)
            places.append(place)
            keys.append(key)
        place, key = np.concatenate(places), np.concatenate(keys)
        # Neighbouring slices may both name an anchor.
        place, once = np.unique(place, return_index=True)
        return place, key[once], np.searchsorted(self.starts, place, "right") - 1

    def contexts(self, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """``WIDTH`` bytes around each anchor, then how many of them lie left and right in
        the text, and padding to whole words."""
        out = np.zeros((len(place), -(-(WIDTH + 2) // 8) * 8), "u1")
        out[:, :WIDTH] = self.bytes[(place - REACH)[:, None] + np.arange(WIDTH)]
        inside = place - self.starts[doc]
        out[:, WIDTH] = np.minimum(REACH, inside)
        out[:, WIDTH + 1] = np.minimum(LENGTH, self.sizes[doc] - inside)
        return out

    def context_hashes(self, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
        step = 1 << 15
        held = [
            _context_hash(self.contexts(place[a : a + step], doc[a : a + step])) for a in range(0, len(place), step)
        ]
        return np.concatenate(held) if held else np.empty(0, np.uint64)


def _coarse(keys: np.ndarray) -> np.ndarray:
    """The upper 48 bits: a clash only makes a gram look shared."""
    return keys & ~np.uint64(0xFFFF)


def _context_hash(contexts: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(contexts).view("<u8").astype(np.uint64)
    total = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        total = _mixed(total * np.uint64(_B) + words[:, i])
    return total


def _single_strings(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every string of each context as a context of its own: context, start and bytes."""
    of, starts, single = [], [], []
    for j in range(REACH + 1):
        ok = np.flatnonzero((j >= REACH - contexts[:, WIDTH]) & (j + LENGTH <= REACH + contexts[:, WIDTH + 1].astype("i4")))
        own = np.zeros((len(ok), contexts.shape[1]), "u1")
        # The string stands at the anchor's place, with nothing to its left.
        own[:, REACH : REACH + LENGTH] = contexts[ok, j : j + LENGTH]
        own[:, WIDTH + 1] = LENGTH
        of.append(ok)
        starts.append(np.full(len(ok), j))
        single.append(own)
    return np.concatenate(of), np.concatenate(starts), np.concatenate(single)


def maximal_repeats(lcp: list[int], left: list[int], least: int) -> list[tuple[int, int, int]]:
    """``(length, first, last)`` of the maximal repeats in sorted suffixes.

    ``lcp[i]`` is the common prefix of suffixes ``i - 1`` and ``i`` (0 at the start and one
    past the end), ``left[i]`` the byte before suffix ``i``, or -1 where there is none. An
    interval is reported if its common prefix has ``least`` bytes and the bytes to the left
    differ; occurrences are the suffixes ``first`` to ``last``.
    """
    found = []
    stack = [[0, 0, _DIVERSE]]
    for i in range(1, len(lcp)):
        now, first, symbol = lcp[i], i - 1, left[i - 1]
        while now < stack[-1][0]:
            length, first, seen = stack.pop()
            if seen != symbol:
                symbol = _DIVERSE
            if symbol == _DIVERSE and length >= least:
                found.append((length, first, i - 1))
        if now > stack[-1][0]:
            stack.append([now, first, symbol])
        elif stack[-1][2] != symbol:
            stack[-1][2] = _DIVERSE
    return found


def _in_smaller_documents(contexts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Per context a bit for each start of a string that a smaller document has as well.

    ``least`` is the smallest document of each context; contexts are distinct.
    """
    bytes_left = contexts[:, WIDTH].astype("i4")
    bytes_right = contexts[:, WIDTH + 1].astype("i4")
    of, starts, lengths, lefts, rows = [], [], [], [], []
    for j in range(REACH + 1):
        ok = np.flatnonzero((j >= REACH - bytes_left) & (j + LENGTH <= REACH + bytes_right))
        row = np.zeros((len(ok), WIDTH), "u1")
        row[:, : WIDTH - j] = contexts[ok, j:WIDTH]
        of.append(ok)
        starts.append(np.full(len(ok), j, "i4"))
        lengths.append(REACH + bytes_right[ok] - j)
        first = REACH - bytes_left[ok] == j
        lefts.append(np.where(first, _DIVERSE, contexts[ok, j - 1].astype("i4") if j else _DIVERSE))
        rows.append(row)
    of, starts, lengths, lefts, rows = map(np.concatenate, (of, starts, lengths, lefts, rows))
    masks = np.zeros(len(contexts), "<u4")
    if len(of) < 2:
        return masks
    order = np.argsort(rows.view(f"S{WIDTH}").ravel(), kind="stable")
    of, starts, lengths, lefts, rows = of[order], starts[order], lengths[order], lefts[order], rows[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
    common = np.minimum(common, np.minimum(lengths[1:], lengths[:-1]))
    lcp = np.concatenate([[0], np.where(common >= LENGTH, common, 0), [0]])
    repeats = maximal_repeats(lcp.tolist(), lefts.tolist(), LENGTH)
    if not repeats:
        return masks
    length, first, last = np.array(repeats).T
    smallest = np.minimum.reduceat(np.append(least[of], _NO_ID), np.column_stack([first, last + 1]).ravel())[::2]
    counts = last - first + 1
    at = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    hit = least[of[at]] > np.repeat(smallest, counts)
    strings = (np.uint64(1) << (np.repeat(length, counts)[hit] - LENGTH + 1).astype(np.uint64)) - np.uint64(1)
    bits = (strings << starts[at[hit]].astype(np.uint64)).astype("<u4")
    np.bitwise_or.at(masks, of[at[hit]], bits)
    return masks


def _anchor_counts(parts: int):
    def count(frame: pd.DataFrame) -> pd.DataFrame:
        _, keys, docs = Bucket(frame).anchors()
        if not len(keys):
            return no_pieces()
        keys = _coarse(keys)
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        once = np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])])
        keys, counts = np.unique(keys[once], return_counts=True)
        return pieces(int(frame["bucket"].iloc[0]), keys, counts, parts)

    return count


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    kinds = {"bucket": "i8", "part": "i4"}
    names = _names(schema)
    return pd.DataFrame(rows, columns=names).astype({n: kinds[n] for n in names if n in kinds})


def _hashed_contexts(parts: int, hot_documents: int):
    """Each distinct context of a shared gram in a bucket, with its smallest document."""

    def contexts(texts: pd.DataFrame, returned: pd.DataFrame) -> pd.DataFrame:
        if not len(texts) or not len(returned):
            return _frame([], HASHED)
        held = Bucket(texts)
        place, keys, docs = held.anchors()
        known = look_up(lookup_table(returned), _coarse(keys))
        place, keys, docs, known = (x[known >= 2] for x in (place, keys, docs, known))
        hot = known > hot_documents
        hashes, least = held.context_hashes(place, docs), held.ids[docs]
        if hot.any():
            of, single = [], []
            for a in range(0, int(hot.sum()), 1 << 12):
                p, d = place[hot][a : a + (1 << 12)], docs[hot][a : a + (1 << 12)]
                own, _, strings = _single_strings(held.contexts(p, d))
                of.append(a + own)
                single.append(_context_hash(strings))
            of, single = np.concatenate(of), np.concatenate(single)
            keys = np.concatenate([keys[~hot], single])
            hashes = np.concatenate([hashes[~hot], single])
            least = np.concatenate([least[~hot], least[hot][of]])
        if not len(keys):
            return _frame([], HASHED)
        order = np.lexsort((least, hashes, keys))
        keys, hashes, least = keys[order], hashes[order], least[order]
        at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (hashes[1:] != hashes[:-1])]))
        repeated = np.maximum.reduceat(least, at) > least[at]
        keys, hashes, least = keys[at], hashes[at], least[at]
        part, edges, ends = ranges(keys, parts)
        bucket = int(texts["bucket"].iloc[0])
        return _frame(
            [
                (bucket, int(part[a]), pack_keys(keys[a:b]), hashes[a:b].tobytes(), least[a:b].tobytes(),
                 repeated[a:b].tobytes())
                for a, b in zip(edges, ends)
            ],
            HASHED,
        )

    return contexts


def _equal_contexts(frame: pd.DataFrame) -> pd.DataFrame:
    """Smallest document of each context over all buckets, and whether its gram has others."""
    held = [unpack_keys(k) for k in frame["keys"]]
    keys = np.concatenate(held)
    hashes = np.frombuffer(b"".join(frame["hashes"]), np.uint64)
    least = np.frombuffer(b"".join(frame["least"]), "i8")
    repeated = np.frombuffer(b"".join(frame["repeated"]), bool)
    order = np.lexsort((least, hashes, keys))
    k, h = keys[order], hashes[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new = new_key.copy()
    new[1:] |= h[1:] != h[:-1]
    at = np.flatnonzero(new)
    several = np.add.reduceat(1 + repeated[order], at) > 1
    contexts_of_key = np.bincount(np.cumsum(new_key[at]) - 1)
    others = np.repeat(contexts_of_key > 1, contexts_of_key)
    group = np.empty(len(keys), "i8")
    group[order] = np.cumsum(new) - 1
    flags = (several * _SEVERAL + others * _OTHERS).astype("u1")[group]
    least = least[order][at][group]
    out, begin = [], 0
    for bucket, own in zip(frame["bucket"], held):
        some = begin + np.flatnonzero(flags[begin : begin + len(own)])
        begin += len(own)
        if len(some):
            out.append((bucket, hashes[some].tobytes(), least[some].tobytes(), flags[some].tobytes()))
    return _frame(out, EQUAL)


def _different_contexts(parts: int):
    """The bytes of contexts whose gram has other contexts."""

    def contexts(texts: pd.DataFrame, equal: pd.DataFrame) -> pd.DataFrame:
        if not len(texts) or not len(equal):
            return _frame([], CONTEXTS)
        told = _Told(equal)
        held = Bucket(texts)
        place, keys, docs = held.anchors()
        hashes = held.context_hashes(place, docs)
        at = told.find(hashes)
        some = np.flatnonzero(told.flags[at] & _OTHERS)
        _, once = np.unique(hashes[some], return_index=True)
        some = some[once]
        some = some[np.argsort(keys[some], kind="stable")]
        keys, least, rows = keys[some], told.least[at[some]], held.contexts(place[some], docs[some])
        part, edges, ends = ranges(keys, parts)
        bucket = int(texts["bucket"].iloc[0])
        return _frame(
            [
                (bucket, int(part[a]), pack_keys(keys[a:b]), rows[a:b].tobytes(), least[a:b].tobytes())
                for a, b in zip(edges, ends)
            ],
            CONTEXTS,
        )

    return contexts


def _compare(frame: pd.DataFrame) -> pd.DataFrame:
    """Contexts of a range of grams, compared with each other; each bucket gets its own back."""
    held = [unpack_keys(k) for k in frame["keys"]]
    keys = np.concatenate(held)
    rows = np.frombuffer(b"".join(frame["contexts"]), "u1").reshape(len(keys), -1)
    least = np.frombuffer(b"".join(frame["least"]), "i8")
    hashes = _context_hash(rows)
    order = np.lexsort((hashes, keys))
    k, h = keys[order], hashes[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])
    at = np.flatnonzero(new)
    distinct = order[at]
    masks = np.zeros(len(at), "<u4")
    key_ends = np.append(np.flatnonzero(k[at][1:] != k[at][:-1]) + 1, len(at))
    begin = 0
    # Whole grams at a time, about TOGETHER contexts.
    while begin < len(at):
        end = int(key_ends[min(np.searchsorted(key_ends, begin + TOGETHER), len(key_ends) - 1)])
        some = distinct[begin:end]
        masks[begin:end] = _in_smaller_documents(rows[some], least[some])
        begin = end
    own_mask = np.empty(len(keys), "<u4")
    own_mask[order] = masks[np.cumsum(new) - 1]
    out, begin = [], 0
    for bucket, own in zip(frame["bucket"], held):
        some = begin + np.flatnonzero(own_mask[begin : begin + len(own)])
        begin += len(own)
        if len(some):
            out.append((bucket, hashes[some].tobytes(), own_mask[some].tobytes()))
    return _frame(out, COVERED)


class _Told:
    """What came back for the contexts of a bucket, by context hash."""

    def __init__(self, answers: pd.DataFrame):
        equal = answers[answers["flags"].notna()]
        joined = [b"".join(equal[c]) for c in ("hashes", "least", "flags")]
        hashes, least, flags = (np.frombuffer(j, kind) for j, kind in zip(joined, (np.uint64, "i8", "u1")))
        order = np.argsort(hashes, kind="stable")
        # An entry behind all others, where searches end that find nothing.
        self.hashes = np.append(hashes[order], np.uint64(2**64 - 1))
        self.least = np.append(least[order], _NO_ID)
        self.flags = np.append(flags[order], np.uint8(0))
        self.masks = np.zeros(len(self.hashes), "<u4")
        if "masks" in answers:
            rows = answers[answers["masks"].notna()]
            of = np.searchsorted(self.hashes, np.frombuffer(b"".join(rows["hashes"]), np.uint64))
            np.bitwise_or.at(self.masks, of, np.frombuffer(b"".join(rows["masks"]), "<u4"))
        if "keys" in answers:
            self.hot = lookup_table(answers[answers["keys"].notna()])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        return np.where(self.hashes[at] == hashes, at, len(self.hashes) - 1)

    def __call__(self, contexts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strings that smaller documents have in other contexts; whether one has this context."""
        at = self.find(_context_hash(contexts))
        return self.masks[at], ids > self.least[at]


def _covered_starts(held: Bucket, told: _Told) -> np.ndarray:
    """Which places of the buffer start a string that a smaller document has."""
    starts = np.zeros(len(held.bytes), bool)
    place, keys, docs = held.anchors()
    is_hot = look_up(told.hot, _coarse(keys)) > 0
    p_all, d_all = place[~is_hot], docs[~is_hot]
    for a in range(0, len(p_all), 1 << 16):
        p, d = p_all[a : a + (1 << 16)], d_all[a : a + (1 << 16)]
        contexts = held.contexts(p, d)
        masks, later = told(contexts, held.ids[d])
        left, right = contexts[:, WIDTH].astype("i4"), contexts[:, WIDTH + 1].astype("i4")
        for j in range(REACH + 1):
            valid = (j >= REACH - left) & (j + LENGTH <= REACH + right)
            hit = valid & (later | ((masks >> np.uint32(j)) & np.uint32(1)).astype(bool))
            starts[p[hit] - REACH + j] = True
    p_hot, d_hot = place[is_hot], docs[is_hot]
    for a in range(0, len(p_hot), 1 << 12):
        p, d = p_hot[a : a + (1 << 12)], d_hot[a : a + (1 << 12)]
        of, j, single = _single_strings(held.contexts(p, d))
        _, later = told(single, held.ids[d[of]])
        starts[p[of[later]] - REACH + j[later]] = True
    return starts


def _remove(texts: pd.DataFrame, covered: pd.DataFrame) -> pd.DataFrame:
    held = Bucket(texts)
    starts = _covered_starts(held, _Told(covered))
    run = np.cumsum(np.concatenate([[0], starts]), dtype="i8")
    # A byte goes if one of the LENGTH strings that hold it starts at a marked place.
    gone = run[1:] > run[np.maximum(0, np.arange(len(starts)) - LENGTH + 1)]
    spans, kept = [], []
    for a, n in zip(held.starts, held.sizes):
        marks = gone[a : a + n]
        turns = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype("i1")))
        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turns[::2], turns[1::2])])
        kept.append(held.bytes[a : a + n][~marks].tobytes())
    return pd.DataFrame({"id": texts["id"].astype("Int64"), "n_bytes": held.sizes, "spans": spans, "kept": kept})


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_documents: int = HOT_DOCUMENTS,
) -> DataFrame:
    """``id, n_bytes, spans, kept``: texts without what smaller documents have, row by row.

    Texts are UTF-8 bytes. A byte is removed if a string of ``LENGTH`` bytes over it also
    starts in a document with a smaller id; strings do not cross documents and are judged
    on the input. ``spans`` are the maximal removed runs, ``kept`` the bytes left.

    Null and empty texts have nothing to remove. A null id counts as larger than every id.
    Rows that share an id do not remove each other's bytes; repeated rows come out as often
    as they come in. An empty table gives no rows. Other columns are ignored. Grams and
    contexts are matched by 64-bit hashes, suffixes by their bytes.
    """
    ship_package(docs.sparkSession)
    buckets = bucket_count(docs, text_col)
    texts = bucketed(docs, buckets, id_col, text_col)
    parts = range_count(buckets)
    by_bucket = texts.groupBy("bucket")
    sent = by_bucket.applyInPandas(_anchor_counts(parts), PIECES)
    shared = totals(sent, at_least=2)
    hashed = by_bucket.cogroup(shared.groupBy("bucket")).applyInPandas(
        _hashed_contexts(parts, hot_documents), HASHED
    )
    equal = hashed.groupBy("part").applyInPandas(_equal_contexts, EQUAL)
    contexts = by_bucket.cogroup(equal.groupBy("bucket")).applyInPandas(_different_contexts(parts), CONTEXTS)
    covered = contexts.groupBy("part").applyInPandas(_compare, COVERED)
    hot = totals(sent, at_least=hot_documents + 1).select("bucket", "keys", "sums")
    answers = equal.unionByName(covered, allowMissingColumns=True).unionByName(hot, allowMissingColumns=True)
    return by_bucket.cogroup(answers.groupBy("bucket")).applyInPandas(_remove, KEPT)
