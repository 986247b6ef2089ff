"""Entity, stratified, random and ordered-tail splits."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gauge_engine.columns import STATIONS, SensorColumns
from gauge_engine.operators.ordering import with_dense_id
from gauge_engine.session import materialize

# Digits of the hash by which a round of the selection tells rows apart, of 32 in all.
HASH_DIGITS = 4
HASH_LENGTH = 32
# The selection ends when the rows around a cut are so few; one task then sorts them.
EDGE_ROWS = 1 << 20


def keep_entities(df: DataFrame, names: Iterable[str], cols: SensorColumns = STATIONS) -> DataFrame:
    """Rows of the named entities; a literal list reaches the scan as a pushed filter."""
    return df.filter(F.col(cols.entity).isin(list(names)))


def keep_listed_entities(df: DataFrame, listing: DataFrame, cols: SensorColumns = STATIONS) -> DataFrame:
    """Rows of the entities in a table; duplicates in the table do not multiply rows.

    Over readings stored by entity the listing prunes folders while the job runs. The
    optimiser tries that only for a listing that is filtered, so the filter for names is
    written as a comparison.
    """
    named = listing.select(cols.entity).where(F.length(F.col(cols.entity).cast("string")) >= 0)
    return df.join(named, cols.entity, "left_semi").select(*df.columns)


def split_entities(
    df: DataFrame, train: Iterable[str], test: Iterable[str], cols: SensorColumns = STATIONS
) -> tuple[DataFrame, DataFrame]:
    return keep_entities(df, train, cols), keep_entities(df, test, cols)


def union_entities(train: DataFrame, test: DataFrame) -> DataFrame:
    """Append two entity lists, keeping duplicates."""
    return train.unionByName(test)


def _hash_order(keys: Sequence[str], seed: int) -> Column:
    parts = [F.col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


@dataclass
class Cutoff:
    """The hash up to which a stratum is marked, and the rounds that led there."""

    hash: str
    rounds: int


def cutoff_hashes(
    slim: DataFrame, share: float, rounding: str, digits: int = HASH_DIGITS, most_rows: int = EDGE_ROWS
) -> dict[bool, Cutoff]:
    """Per stratum of ``_stratum, _hash`` the smallest hashes' last one, by radix selection.

    A round counts the rows by their next ``digits`` behind the prefix that the round before
    arrived at, and goes on with the one prefix in which the cut falls, until it holds at most
    ``most_rows`` rows. Only that prefix is sorted. Rounds bring back a row per stratum, and
    there are two strata at most. Equal hashes cannot be told apart and are marked together.
    """
    known = slim.where("_stratum IS NOT NULL")
    rounder = F.ceil if rounding == "ceil" else F.floor
    each = Window.partitionBy("_stratum")
    found: dict[bool, Cutoff] = {}
    open_at: dict[bool, tuple[str, int, int]] = {}  # stratum: prefix, rows still wanted behind it, rounds

    def inside(strata: dict[bool, tuple[str, int, int]]) -> Column:
        hit = F.lit(False)
        for stratum, (prefix, _, _) in strata.items():
            hit = hit | ((F.col("_stratum") == stratum) & F.col("_hash").startswith(prefix))
        return hit

    def wanted() -> Column:
        if not open_at:
            return rounder(F.lit(share) * F.sum("_rows").over(each)).cast("bigint")
        want = F.lit(None).cast("bigint")
        for stratum, (_, need, _) in open_at.items():
            want = F.when(F.col("_stratum") == stratum, F.lit(need)).otherwise(want)
        return want

    length = 0
    while length == 0 or open_at:
        rows = known.where(inside(open_at)) if open_at else known
        upto = F.substring("_hash", 1, length + digits).alias("_prefix")
        counts = rows.groupBy("_stratum", upto).agg(F.count(F.lit(1)).alias("_rows"))
        placed = counts.withColumns({"_upto": F.sum("_rows").over(each.orderBy("_prefix")), "_want": wanted()})
        before = F.col("_upto") - F.col("_rows")
        edges = placed.where((before < F.col("_want")) & (F.col("_want") <= F.col("_upto"))).collect()
        length += digits
        rounds = {s: r for s, (_, _, r) in open_at.items()}
        open_at, small = {}, {}
        for e in edges:
            state = (e._prefix, e._want - e._upto + e._rows, rounds.get(e._stratum, 0) + 1)
            if length >= HASH_LENGTH:
                found[e._stratum] = Cutoff(e._prefix, state[2])
            else:
                (small if e._rows <= most_rows else open_at)[e._stratum] = state
        if small:
            need = F.lit(None).cast("bigint")
            for stratum, (_, n, _) in small.items():
                need = F.when(F.col("_stratum") == stratum, F.lit(n)).otherwise(need)
            ranked = known.where(inside(small)).withColumn("_rank", F.row_number().over(each.orderBy("_hash")))
            for row in ranked.where(F.col("_rank") == need).collect():
                found[row._stratum] = Cutoff(row._hash, small[row._stratum][2])
    return found


def _mark_smallest_hashes(
    df: DataFrame, keys: Sequence[str], stratum: Column | None, share: float, rounding: str, seed: int, out: str
) -> DataFrame:
    """Mark exactly ``share`` of each stratum: the rows with the smallest key hash.

    The cut-off hash of each stratum is selected first; every row is then compared with it in
    place. The full table is never sorted or shuffled, and a stratum that holds most rows
    costs no more than a small one. ``keys`` must identify a row.
    """
    classes = F.lit(True) if stratum is None else stratum
    hashed = _hash_order(keys, seed)
    # The rounds read the written hashes, so ``df`` is computed twice in all.
    slim = materialize(df.select(classes.alias("_stratum"), hashed.alias("_hash")), "split-hashes")
    marked = F.lit(False)
    for value, cutoff in cutoff_hashes(slim, share, rounding).items():
        marked = marked | ((classes == value) & (hashed <= cutoff.hash))
    return df.withColumn(out, F.coalesce(marked, F.lit(False)))


def split_stratified(
    df: DataFrame,
    keys: Sequence[str],
    label: str = "y",
    share: float = 0.2,
    seed: int = 42,
    out: str = "is_validation",
) -> DataFrame:
    """Mark ``ceil(share * n)`` rows of each class for validation, reproducibly."""
    return _mark_smallest_hashes(df, keys, F.col(label) == 1, share, "ceil", seed, out)


def split_random(
    df: DataFrame, keys: Sequence[str], share: float = 0.1, seed: int = 42, out: str = "is_validation"
) -> DataFrame:
    """Mark ``floor(share * n)`` rows for validation; independent of the partitioning."""
    return _mark_smallest_hashes(df, keys, None, share, "floor", seed, out)


def split_tail(
    df: DataFrame,
    order: Sequence[str],
    share: float = 0.1,
    cols: SensorColumns = STATIONS,
    out: str = "is_validation",
) -> DataFrame:
    """Mark the last ``floor(share * n)`` rows in (entity, order) for validation."""
    placed = with_dense_id(df, cols.entity, order, "_place")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    cut = total - F.floor(F.lit(share) * total)
    return placed.withColumn(out, F.col("_place") >= cut).drop("_place")
