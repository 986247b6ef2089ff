"""Scoring of texts with a probabilistic suffix tree over words.

The tree's contexts are the empty one, single words and pairs of words. A word's
probability behind a context is the context's counts smoothed with the probability behind
its longest shorter context that is kept, down to the smoothed word frequencies at the
root. A context is kept when the training texts hold it ``least_count`` times and its next
words diverge from those of the shorter context by ``divergence`` nats or more. The
divergence leaves each occurrence out of the counts that predict it, so chance alone does
not look like divergence. A text is scored word by word in the state of its longest kept
context.

All counts are sums over the buckets of the table (``exchange``), for training and
held-out texts alike, so nothing that grows with the corpus passes the driver, a broadcast
or one task. Divergence is a sum over the occurrences of a context, each of which knows
the counts of its own words; so it is the same kind of sum.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from gauge_engine.llm.exchange import (
    PIECES,
    aligned_totals,
    bucket_count,
    bucketed,
    cut_keys,
    distinct_and_total,
    key_bits,
    pieces,
    range_count,
    unpack_sums,
)
from gauge_engine.llm.shipping import ship_package

LEAST_COUNT = 16
DIVERGENCE = 0.02
# Weight of the shorter context's distribution, in occurrences.
SMOOTHING = 4.0

SCORES = (
    "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)

_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_SPACE = np.isin(np.arange(256), list(b"\t\n\v\f\r "))
# A number for every byte at every place of a word; places repeat after so many.
_PLACES = 64
_BYTES = _mix(_mix(np.arange(1, 256 * _PLACES + 1, dtype=np.uint64) * _M))
_END = _M


def _word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in one row, and how many words each text has.

    Words are cut at ASCII white space, A-Z lower-cased. A word's hash sums the numbers of
    its bytes at their places.
    """
    held = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    ends = np.cumsum([len(b) + 1 for b in held])
    letters = np.frombuffer(b" ".join(held), "u1")
    inside = ~_SPACE[letters]
    edges = np.diff(np.concatenate([[False], inside, [False]]).view("i1"))
    starts = np.flatnonzero(edges == 1)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(held), "i8")
    lengths = np.flatnonzero(edges == -1) - starts
    first = np.cumsum(lengths) - lengths
    letters = letters[inside]
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    numbers = _BYTES[(place % _PLACES << 8) + letters]
    late = np.flatnonzero(place >= _PLACES)
    numbers[late] = _mix(numbers[late] + (place[late] // _PLACES).astype(np.uint64) * _M)
    of_text = np.searchsorted(ends, starts, side="right")
    return np.add.reduceat(numbers, first), np.bincount(of_text, minlength=len(held))


def is_held_out(number: int | None) -> bool:
    """Decided by the crc32 of the id as text; a row without an id is training."""
    return number is not None and zlib.crc32(str(number).encode()) % 5 == 1


class _Distinct:
    """Distinct n-grams of a bucket: ``codes`` per occurrence, and their hashed keys in order."""

    def __init__(self, codes: np.ndarray, keys: np.ndarray):
        self.codes = codes
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def sent(self, weights: np.ndarray) -> np.ndarray:
        """Sums of ``weights`` per n-gram, in the order of the keys."""
        summed = np.bincount(self.codes, weights=weights, minlength=len(self.order))[self.order]
        return summed if weights.dtype.kind == "f" else summed.astype("i8")

    def told(self, totals_in_order: np.ndarray) -> np.ndarray:
        """The total of each n-gram, by code."""
        per_code = np.empty(len(self.order), totals_in_order.dtype)
        per_code[self.order] = totals_in_order
        return per_code


class _Tokens:
    """All tokens of a bucket in one row: words, each text closed by the end token.

    ``has1`` and ``has2`` tell where one and two tokens of the same text come before.
    """

    def __init__(self, frame: pd.DataFrame, bits: int):
        self.bits = bits
        self.numbers = [None if n is pd.NA else int(n) for n in frame["id"].astype("Int64")]
        hashed, counts = _word_hashes(list(frame["text"]))
        self.sizes = counts + 1
        ends = np.zeros(self.sizes.sum(), bool)
        ends[np.cumsum(self.sizes) - 1] = True
        all_words = np.full(len(ends), _END)
        all_words[~ends] = hashed
        word, found = pd.factorize(all_words)
        hashes = _mix(found)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.held_out = np.array([is_held_out(n) for n in self.numbers], bool)
        self.training = np.repeat(~self.held_out, self.sizes)
        place = np.arange(len(word)) - np.repeat(self.starts, self.sizes)
        self.has1, self.has2 = place >= 1, place >= 2
        self.words = _Distinct(word, hashes)
        # Pairs at the places that have one; the code of all others is never read.
        self.previous = np.concatenate([word[:1], word[:-1]])
        codes2, pairs = pd.factorize((self.previous * len(hashes) + word)[self.has1])
        first, second = np.divmod(pairs, len(hashes))
        keys = _mix(_mix(hashes[first]) * _M + hashes[second])
        self.pairs = _Distinct(codes2, cut_keys(keys, bits))
        self.pair = np.zeros(len(word), "i8")
        self.pair[self.has1] = codes2
        self.before = np.concatenate([self.pair[:1], self.pair[:-1]])
        self._pair_keys, self._hashes = keys, hashes

    def triples(self, at: np.ndarray) -> _Distinct:
        """Words behind the pairs before them, at the places named."""
        word, size = self.words.codes[at], len(self._hashes)
        codes, triples = pd.factorize(self.before[at] * size + word)
        pair, last = np.divmod(triples, size)
        keys = _mix(_mix(self._pair_keys[pair] + np.uint64(1)) * _M + self._hashes[last])
        return _Distinct(codes, cut_keys(keys, self.bits))


class _Counts:
    """Training counts at each token: of it, with one and two before it, and of those."""

    def __init__(self, t: _Tokens, returned: pd.DataFrame, parts: int, least_count: int):
        words, pairs = (grams.told(found) for grams, found in zip((t.words, t.pairs), _answer(returned, "counts", parts)))
        self.word = words[t.words.codes]
        self.context1 = words[t.previous]
        self.pair, self.context2 = (
            (pairs[t.pair], pairs[t.before]) if len(pairs) else (np.zeros(len(self.word), "i8"),) * 2
        )
        # Places whose contexts are frequent enough to be kept.
        self.one = t.has1 & (self.context1 >= least_count)
        self.two = t.has2 & (self.context2 >= least_count)

    def root(self, returned: pd.DataFrame) -> np.ndarray:
        tokens, distinct = _root_of(returned)
        return (self.word + 0.5) / (tokens + 0.5 * (distinct + 1))


def _answer(returned: pd.DataFrame, name: str, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's totals of one exchange in the order of its keys: those of the ranges below
    ``parts``, and the others."""
    ranges, sums = returned[name].iloc[0], returned[f"{name}_sums"].iloc[0]
    # Ranges come in order; a bucket without keys has no answer.
    below = 0 if ranges is None else int(np.searchsorted(ranges, parts))
    both = (sums[:below], sums[below:]) if ranges is not None else ((), ())
    return tuple(np.concatenate([unpack_sums(s) for s in some]) if len(some) else np.empty(0, "i8") for some in both)


def _root_of(returned: pd.DataFrame) -> tuple[int, int]:
    """Training tokens and distinct training words, which every returned row repeats."""
    return int(returned["tokens"].iloc[0]), int(returned["distinct"].iloc[0])


def _short_counts(parts: int, bits: int):
    """Words in the ranges below ``parts``, pairs in those from there on."""

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        t = _Tokens(frame, bits)
        bucket = int(frame["bucket"].iloc[0])
        return pd.concat(
            [
                pieces(bucket, t.words.keys, t.words.sent(t.training), parts),
                pieces(bucket, t.pairs.keys, t.pairs.sent(t.training[t.has1]), parts, first_part=parts),
            ]
        )

    return count


def _triple_counts(parts: int, bits: int, least_count: int):
    """Words behind the pairs that are frequent enough to be contexts."""

    def count(texts: pd.DataFrame, returned: pd.DataFrame) -> pd.DataFrame:
        t = _Tokens(texts, bits)
        c = _Counts(t, returned, parts, least_count)
        triples = t.triples(c.two)
        return pieces(int(texts["bucket"].iloc[0]), triples.keys, triples.sent(t.training[c.two]), parts)

    return count


def _gain(times: np.ndarray, of: np.ndarray, shorter: np.ndarray, smoothing: float) -> np.ndarray:
    """Log ratio of an occurrence's probability behind a context, itself left out, to the
    probability ``shorter`` behind the shorter context."""
    return np.log((times - 1 + smoothing * shorter) / ((of - 1 + smoothing) * shorter))


def _contexts(t: _Tokens, c: _Counts) -> tuple[_Distinct, _Distinct]:
    """The distinct contexts of one word and of two that are frequent enough, with the
    occurrences behind them."""
    out = []
    for at, codes, grams in ((c.one, t.previous, t.words), (c.two, t.before, t.pairs)):
        keys = np.empty(len(grams.keys), np.uint64)
        keys[grams.order] = grams.keys
        local, seen = pd.factorize(codes[at])
        out.append(_Distinct(local, keys[seen] if len(seen) else np.empty(0, np.uint64)))
    return out[0], out[1]


def _divergences(parts: int, bits: int, least_count: int, divergence: float, smoothing: float):
    """What each training occurrence adds to its contexts' divergence from shorter ones, less
    the divergence asked for: a context is kept if its sum is 0 or more."""

    def gather(texts: pd.DataFrame, returned: pd.DataFrame) -> pd.DataFrame:
        t = _Tokens(texts, bits)
        c = _Counts(t, returned, parts, least_count)
        base = c.root(returned)
        ones, twos = _contexts(t, c)
        # Words behind a word, against words anywhere.
        own = c.one & t.training
        gain1 = np.zeros(len(own))
        gain1[own] = _gain(c.pair[own], c.context1[own], base[own], smoothing) - divergence
        # Words behind a pair, against words behind its second word.
        own = c.two & t.training
        shorter = (c.pair[own] - 1 + smoothing * base[own]) / (c.context1[own] - 1 + smoothing)
        triples = t.triples(c.two)
        times = triples.told(_answer(returned, "triples", parts)[0])[triples.codes]
        gain2 = np.zeros(len(own))
        gain2[own] = _gain(times[t.training[c.two]], c.context2[own], shorter, smoothing) - divergence
        bucket = int(texts["bucket"].iloc[0])
        return pd.concat(
            [
                pieces(bucket, ones.keys, ones.sent(gain1[c.one]), parts),
                pieces(bucket, twos.keys, twos.sent(gain2[c.two]), parts, first_part=parts),
            ]
        )

    return gather


def _scored(parts: int, bits: int, least_count: int, smoothing: float):
    def score(texts: pd.DataFrame, returned: pd.DataFrame) -> pd.DataFrame:
        t = _Tokens(texts, bits)
        c = _Counts(t, returned, parts, least_count)
        base = c.root(returned)
        gains = _answer(returned, "gains", parts)
        triples = t.triples(c.two)
        times = triples.told(_answer(returned, "triples", parts)[0])[triples.codes]
        p = base.copy()
        ones, twos = _contexts(t, c)
        for at, contexts, of, seen, gain in (
            (c.one, ones, c.context1, c.pair[c.one], gains[0]),
            (c.two, twos, c.context2, times, gains[1]),
        ):
            kept = contexts.told(gain)[contexts.codes] > 0
            places = np.flatnonzero(at)[kept]
            p[places] = (seen[kept] + smoothing * p[places]) / (of[places] + smoothing)

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, t.starts)

        return pd.DataFrame(
            {
                "id": pd.array(t.numbers, "Int64"),
                "held_out": t.held_out,
                "n_tokens": t.sizes,
                "n_known": per_text((c.word > 0).astype("i8")),
                "train_tokens": _root_of(returned)[0],
                "base_score": per_text(np.log10(base)),
                "score": per_text(np.log10(p)),
            }
        )

    return score


def suffix_tree_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT,
    divergence: float = DIVERGENCE, smoothing: float = SMOOTHING,
) -> DataFrame:
    """``SCORES``: per row its tokens, those known from training, and two log10 probabilities.

    Texts are lower-cased (A-Z) words and an end token. Rows whose ``crc32(id as text) % 5``
    is 1 are held out; the model learns from all others. ``base_score`` sums
    ``log10((c + 0.5) / (N + 0.5 * (V + 1)))``, ``score`` the tree's log10 probabilities.

    Null and empty texts are the end token alone. A row without an id is training. Repeated
    rows count as often as they come. An empty table gives no rows; if all texts are held
    out, every count is 0. Other columns are ignored. Words are counted by 64-bit hashes,
    pairs and triples by as many bits as tell all but one in 16,384 of them apart.
    """
    ship_package(docs.sparkSession)
    buckets = bucket_count(docs, text_col)
    texts = bucketed(docs, buckets, id_col, text_col)
    by_bucket = texts.drop("key").groupBy("bucket")
    parts, bits = range_count(buckets), key_bits(buckets)
    sent = by_bucket.applyInPandas(_short_counts(parts, bits), PIECES)
    root = distinct_and_total(sent, parts)

    def answer(name: str, sums: DataFrame) -> DataFrame:
        """A row per bucket: the ranges in order, and their sums. It is shuffled once, however
        many passes read it."""
        each = sums.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("part", "sums"))).alias("a"))
        return each.select("bucket", F.col("a.part").alias(name), F.col("a.sums").alias(f"{name}_sums"))

    def with_root(answers: DataFrame) -> GroupedData:
        """Answers by bucket, each row with the two numbers of the root."""
        return answers.withColumns(
            {"tokens": root.select("total").scalar(), "distinct": root.select("distinct").scalar()}
        ).groupBy("bucket")

    def gathered(function, answers: DataFrame, signs: bool = False) -> DataFrame:
        return aligned_totals(by_bucket.cogroup(with_root(answers)).applyInPandas(function, PIECES), signs)

    # Every bucket has words, but not always frequent contexts.
    counts = answer("counts", aligned_totals(sent))
    triples = counts.join(answer("triples", gathered(_triple_counts(parts, bits, least_count), counts)), "bucket", "left")
    gains = gathered(_divergences(parts, bits, least_count, divergence, smoothing), triples, signs=True)
    return by_bucket.cogroup(with_root(triples.join(answer("gains", gains), "bucket", "left"))).applyInPandas(
        _scored(parts, bits, least_count, smoothing), SCORES
    )
