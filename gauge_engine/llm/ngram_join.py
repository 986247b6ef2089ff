"""Exact Jaccard self-join of documents on word shingles, by grouped prefixes.

Shingles are ordered by how many documents hold them, rare ones first. Two sets that are
similar enough share a shingle in their prefixes, the first few in that order; a shingle
that one document alone holds matches nothing, so it takes a place in the prefix but is
not indexed. Sets with the same size and the same indexed prefix form one group. Group
pairs that share a prefix shingle are filtered by size and by position; members of the
pairs left are compared in full.

Groups are not expanded pair by pair. A round compares, for each prefix shingle, one
member of the most common component with all groups that are not in that component yet;
components then grow, and what one component holds is never compared again. Sets
that are still apart after the rounds are paired without exception, so the result is
exact; rounds only decide how few comparisons that takes. Before a pair is compared in
full, a bitmap of each set, one bit per hash value telling whether an odd number of
shingles has it, bounds from below in how many shingles the two differ; and it is made at
the first shingle the two have in common, not at each of them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gauge_engine.llm.components import connected_components, materialize_counted
from gauge_engine.llm.exchange import bucket_count, bucketed, look_up, lookup_table, no_pieces, pieces, range_count, totals
from gauge_engine.llm.exchange import PIECES
from gauge_engine.llm.shipping import ship_package
from gauge_engine.session import materialize

STAR_ROUNDS = 2
BITMAP_WORDS = 4

SETS = (
    "key bigint, id bigint, set_key bigint, n bigint, shared array<bigint>, prefix array<bigint>, alone bigint, "
    "bitmap array<bigint>"
)

_M1, _M2, _M3 = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class WordHashes(dict):
    """Word -> 64-bit hash, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 1_000_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, cut at blank, tab, line ends and form feeds."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_keys(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit keys of the shingles; of all words as one if they are fewer."""
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=size)], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    count = len(words) - size + 1
    keys = h[:count].copy()
    for i in range(1, size):
        keys *= _M1
        keys += h[i : i + count]
        keys ^= keys >> np.uint64(31)
    keys *= _M2
    keys ^= keys >> np.uint64(29)
    keys *= _M3
    keys ^= keys >> np.uint64(32)
    return np.unique(keys)


def _coarse(keys: np.ndarray) -> np.ndarray:
    """The upper 48 bits: enough to order shingles; a clash only makes one look shared."""
    return keys & ~np.uint64(0xFFFF)


def _bitmap(keys: np.ndarray) -> np.ndarray:
    """Parities of how many keys fall on each of ``BITMAP_WORDS * 64`` values."""
    counts = np.bincount((keys & np.uint64(64 * BITMAP_WORDS - 1)).astype("i8"), minlength=64 * BITMAP_WORDS)
    return np.packbits((counts & 1).astype("u1")).view("<i8")


def _shingle_counts(size: int, parts: int):
    def count(frame: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        held = [shingle_keys(words_of(t), size, hashes) for t in frame["text"]]
        keys = np.concatenate(held) if held else np.empty(0, np.uint64)
        if not len(keys):
            return no_pieces()
        keys, counts = np.unique(_coarse(keys), return_counts=True)
        return pieces(int(frame["bucket"].iloc[0]), keys, counts, parts)

    return count


def _indexed_sets(size: int, percent: int):
    def index(texts: pd.DataFrame, returned: pd.DataFrame) -> pd.DataFrame:
        import xxhash

        known = lookup_table(returned)
        hashes = WordHashes()
        rows = []
        for key, number, text in zip(texts["key"], texts["id"].astype("Int64"), texts["text"]):
            keys = shingle_keys(words_of(text), size, hashes)
            n = len(keys)
            number = None if number is pd.NA else int(number)
            set_key = np.uint64(xxhash.xxh3_64_intdigest(keys.tobytes())).astype("i8") if n else None
            counts = look_up(known, _coarse(keys))
            shared, counts = keys[counts > 1], counts[counts > 1]
            alone = n - len(shared)
            length = n - (percent * n + 99) // 100 + 1 if n else 0
            if number is None or length <= alone:
                rows.append((key, number, set_key, n, None, None, None, None))
                continue
            order = np.lexsort((shared, counts))[: length - alone]
            rows.append((key, number, set_key, n, shared.astype("i8"), shared[order].astype("i8"), alone, _bitmap(keys)))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in SETS.split(", ")])
        return out.astype({"id": "Int64", "set_key": "Int64", "n": "i8", "alone": "Int64"})

    return index


def _links(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the pairs of sets that are similar enough, compared in full."""
    left = members.select(*[F.col(c).alias(f"a_{c}") for c in members.columns]).withColumnRenamed("a_set_key", "a")
    right = members.select(*[F.col(c).alias(f"b_{c}") for c in members.columns]).withColumnRenamed("b_set_key", "b")
    both = F.size(F.array_intersect("a_shared", "b_shared")).cast("bigint")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where((100 + percent) * both >= percent * (F.col("a_n") + F.col("b_n")))
        .select("a", "b")
    )


def _can_match(a: str, b: str, percent: int) -> Column:
    """Size and position filter of two groups that share a prefix shingle.

    Behind the shared one, at most the shorter rest can match; before it, at most the
    shorter indexed head.
    """
    rest = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    most = F.least(f"{a}.i", f"{b}.i") + rest
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (
        (100 * F.least(n, m) >= percent * F.greatest(n, m))
        & ((100 + percent) * most >= percent * (n + m))
    )


def _few_differences(a: str, b: str, percent: int) -> Column:
    """Bits in which the bitmaps differ are as many shingles at least."""
    bits = [F.bit_count(F.get(f"{a}.bitmap", F.lit(w)).bitwiseXOR(F.get(f"{b}.bitmap", F.lit(w)))) for w in range(BITMAP_WORDS)]
    return (100 + percent) * sum(bits[1:], bits[0]) <= (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _met_once(apart: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of sets of two components that share a token and pass the filters.

    ``apart`` has a row per token and set. Two sets share most of their tokens if they share
    any, so a pair is made only by the first one: no token before it is in both prefixes.
    The filters hold at every shared token, so none is lost by that.
    """
    placed = apart.withColumn("earlier", F.slice("prefix", F.lit(1), F.col("i"))).drop("prefix")
    return (
        placed.alias("x")
        .join(placed.alias("y"), "token")
        .where(
            (F.col("x.component") < F.col("y.component"))
            & _few_differences("x", "y", percent)
            & _can_match("x", "y", percent)
            & ~F.arrays_overlap("x.earlier", "y.earlier")
        )
        .select(F.col("x.set_key").alias("a"), F.col("y.set_key").alias("b"))
    )


def ngram_components(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Near-duplicate components: ``key, id, n_shingles, component``, a row per row of ``docs``.

    ``key`` is a hash of id and text and names the row.
    A document's set holds its distinct ``size``-word shingles; with fewer words, all words
    as one shingle. Two sets are linked when ``100 * intersection >= percent * union``;
    ``component`` is the smallest id reachable over links.

    Null and empty texts, and texts without a word, have an empty set, which is linked with
    nothing. A row without an id is linked with nothing and has no component. Rows with the
    same text and id come out as often as they come in; rows that share an id but not a
    text are compared each by its own text. An empty table gives no rows. Other columns are
    ignored. Words and shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    ship_package(spark)
    buckets = bucket_count(docs, text_col)
    texts = bucketed(docs, buckets, id_col, text_col)
    parts = range_count(buckets)
    sent = texts.groupBy("bucket").applyInPandas(_shingle_counts(size, parts), PIECES)
    returned = totals(sent, at_least=2)
    rows = materialize(
        texts.groupBy("bucket").cogroup(returned.groupBy("bucket")).applyInPandas(_indexed_sets(size, percent), SETS),
        "shingle-sets",
    )

    # One row per distinct set; equal sets are one node from here on.
    sets = materialize(
        rows.where("prefix IS NOT NULL")
        .groupBy("set_key")
        .agg(*[F.first(c).alias(c) for c in ("n", "shared", "prefix", "alone", "bitmap")], F.min("id").alias("first_id"))
        .withColumn("gid", F.xxhash64("n", "alone", "prefix")),
        "distinct-sets",
    )
    members = sets.select("set_key", "n", "shared")
    groups = materialize(
        sets.groupBy("gid").agg(
            F.min("set_key").alias("leader"), F.first("n").alias("n"), F.first("alone").alias("alone"),
            F.first("prefix").alias("prefix"),
        ),
        "prefix-groups",
    )
    tokens = groups.select("gid", "n", "alone", F.posexplode("prefix").alias("i", "token")).select(
        "token", "gid", "n", "i", (F.col("alone") + F.col("i")).alias("pos")
    )
    of_group = sets.select("gid", "set_key")

    def components(links: DataFrame) -> DataFrame:
        found = connected_components(links, "a", "b")
        return of_group.join(found.withColumnRenamed("node", "set_key"), "set_key", "left").select(
            "gid", "set_key", F.coalesce("component", "set_key").alias("component")
        )

    # Members against the first of their own group.
    first = of_group.join(groups.select("gid", "leader"), "gid").where("set_key <> leader")
    links = [materialize(_links(first.select(F.col("leader").alias("a"), F.col("set_key").alias("b")), members, percent), "links")]

    for turn in range(STAR_ROUNDS + 1):
        parted = materialize(components(reduce(DataFrame.union, links)), "parted")
        # What one component holds of one group is a unit, with one member speaking for it.
        units = parted.groupBy("gid", "component").agg(F.min("set_key").alias("speaker"))
        placed = tokens.join(units, "gid")
        # Only shingles met by two components can still bring a link.
        most = placed.groupBy("token", "component").agg(F.count("gid").alias("units"))
        hub_component = most.groupBy("token").agg(
            F.max_by("component", F.struct("units", "component")).alias("component"), F.count("units").alias("parts")
        ).where("parts > 1").drop("parts")
        hub, contested = materialize_counted(
            placed.join(hub_component, ["token", "component"])
            .groupBy("token", "component")
            .agg(F.min_by(F.struct("gid", "n", "i", "pos", "speaker"), F.xxhash64("speaker", F.lit(turn))).alias("hub"))
            .select("token", F.col("component").alias("hub_component"), "hub.*"),
            "hubs",
        )
        if not contested:
            break
        if turn < STAR_ROUNDS:
            near = (
                placed.alias("x")
                .join(hub.alias("h"), "token")
                .where((F.col("x.component") != F.col("h.hub_component")) & _can_match("x", "h", percent))
                .select(F.col("h.speaker").alias("a"), F.col("x.gid").alias("gid"), F.col("x.component").alias("component"))
                .distinct()
            )
            pairs = near.join(parted, ["gid", "component"]).select("a", F.col("set_key").alias("b"))
        else:
            apart = (
                tokens.join(hub.select("token"), "token", "left_semi")
                .join(parted, "gid")
                .join(sets.select("set_key", "bitmap", "prefix"), "set_key")
            )
            pairs = _met_once(apart, percent)
        links.append(materialize(_links(pairs.distinct(), members, percent), "links"))

    found = connected_components(reduce(DataFrame.union, links), "a", "b")
    named = (
        sets.select("set_key", "first_id")
        .join(found.withColumnRenamed("node", "set_key"), "set_key", "left")
        .withColumn("component", F.coalesce("component", "set_key"))
    )
    smallest = named.groupBy("component").agg(F.min("first_id").alias("smallest"))
    of_set = named.join(smallest, "component").select("set_key", "smallest")
    return (
        rows.select("key", "id", "set_key", "n")
        .join(of_set, "set_key", "left")
        .select(
            "key", "id", F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("smallest", "id")).alias("component"),
        )
    )
