"""Joins of points with intervals, and seed intervals: history blocks and following-horizon
truth per (interval, entity).

An interval is cut into aligned pieces, each twice as long as those of the level below: a
number of pieces that grows with the logarithm of its length. A point lies in one piece of
every level. Points and intervals are equi-joined on (level, piece), so the join stays a
hash or sort-merge join however many and however long the intervals are, and every pair meets
once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gauge_engine.columns import HISTORY_DAYS, HORIZON_DAYS, STATIONS, SensorColumns
from gauge_engine.functions.arrays import flatten_block, zero_horizon
from gauge_engine.operators.splits import keep_entities

EPOCH = "1970-01-01"
# Levels that hold every day number of a date, and every hour of a timestamp.
LEVELS = 24
SECONDS_PER_UNIT = 3600
# Running sums of a block are taken over about 2^8 equal parts of it first.
PART_BITS = 8


def day_number(day: str | Column) -> Column:
    return F.datediff(day, F.lit(EPOCH)).cast("bigint")


def interval_pieces(intervals: DataFrame, first: Column, last: Column, levels: int = LEVELS) -> DataFrame:
    """One row per aligned piece ``_level, _piece`` of the whole numbers ``first`` to ``last``.

    Pieces of level k are 2^k long. At most two of a level belong to an interval: one that
    begins at an odd place and one that ends there. An interval that ends before it starts
    has none.
    """
    bounded = intervals.withColumns({"_first": first, "_last": last})

    def of_level(k: Column) -> Column:
        low = -F.call_function("shiftright", -F.col("_first"), k)
        high = F.call_function("shiftright", F.col("_last") + 1, k)
        opens = (low < high) & (low.bitwiseAND(1) == 1)
        closes = (low < high) & (high.bitwiseAND(1) == 1)
        piece = F.struct(k.cast("int").alias("_level"), low.alias("_piece"))
        return F.array(F.when(opens, piece), F.when(closes, piece.withField("_piece", high - 1)))

    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), of_level))
    return bounded.withColumn("_at", F.explode(F.array_compact(pieces))).select(*intervals.columns, "_at.*")


def join_intervals(
    points: DataFrame, intervals: DataFrame, at: Column, first: Column, last: Column, levels: int = LEVELS
) -> DataFrame:
    """Every pair of a point and an interval that holds it: ``first`` <= ``at`` <= ``last``.

    A point is repeated only for the levels on which some interval has a piece.
    """
    pieces = interval_pieces(intervals, first, last, levels)
    used = pieces.agg(F.collect_set("_level").alias("levels")).scalar()
    placed = points.withColumns({"_point": at, "_level": F.explode(used)})
    placed = placed.withColumn("_piece", F.call_function("shiftright", "_point", "_level")).drop("_point")
    return placed.join(pieces, ["_level", "_piece"]).drop("_level", "_piece")


def readings_in_intervals(
    readings: DataFrame,
    intervals: DataFrame,
    time: str,
    start: str = "start_time",
    end: str = "end_time",
    seconds: int = SECONDS_PER_UNIT,
    by: Sequence[str] | None = None,
    sums: Mapping[str, str] | None = None,
) -> DataFrame:
    """Every pair of a reading and an interval with ``start`` <= time < ``end``.

    Readings and pieces meet by units of ``seconds``; the exact times decide. Readings and
    intervals without a time, and empty intervals, meet nothing.

    With ``by``, columns of either table, the pairs are counted and not listed: ``n`` pairs
    and the ``sums`` (name -> column of the readings) per combination that some pair has.
    The work then grows with the readings and the intervals, not with their pairs.
    """
    if by is not None:
        return _totals_in_intervals(readings, intervals, time, start, end, by, sums or {})

    def unit(moment: str) -> Column:
        since = F.timestamp_diff("SECOND", F.lit(f"{EPOCH} 00:00:00").cast("timestamp_ntz"), F.col(moment).cast("timestamp_ntz"))
        return F.floor(since / seconds)

    found = join_intervals(readings, intervals.where(F.col(start) < F.col(end)), unit(time), unit(start), unit(end))
    return found.where((F.col(start) <= F.col(time)) & (F.col(time) < F.col(end)))


def _microseconds(readings: DataFrame, time: str, intervals: DataFrame, *bounds: str) -> Callable[[str], Column]:
    """Times as whole microseconds, in the type in which Spark compares these columns."""
    types = {readings.schema[time].dataType.typeName(), *[intervals.schema[c].dataType.typeName() for c in bounds]}
    if "timestamp" in types:
        return lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    zero = F.lit(f"{EPOCH} 00:00:00").cast("timestamp_ntz")
    return lambda c: F.timestamp_diff("MICROSECOND", zero, F.col(c).cast("timestamp_ntz"))


def _totals_in_intervals(
    readings: DataFrame, intervals: DataFrame, time: str, start: str, end: str, by: Sequence[str], sums: Mapping[str, str]
) -> DataFrame:
    """Counts and sums of the pairs, from running sums.

    Time is cut into aligned blocks, for an interval into the longest of 2^k microseconds
    that are not longer than it. It then ends in the next block or the one after that: it
    holds the end of one block, perhaps a whole one, and the beginning of one. Those are
    sums that run backwards from a block's end or forwards from its beginning, read where
    the interval begins or ends; nothing is subtracted.
    """
    of_interval = [c for c in by if c in intervals.columns]
    of_reading = [c for c in by if c not in intervals.columns]
    totals = ["n", *sums]
    micros = _microseconds(readings, time, intervals, start, end)

    def block(at: Column) -> Column:
        return F.call_function("shiftright", at, F.col("_level"))

    first, last = F.col("_first"), F.col("_last")
    bounded = (
        intervals.select(*of_interval, micros(start).alias("_first"), micros(end).alias("_last"))
        .where(first < last)
        .withColumn("_level", F.length(F.bin(last - first)) - 1)
    )

    def part(at: Column, side: int | None, order: Column) -> Column:
        return F.struct(at.alias("_block"), F.lit(side).cast("int").alias("_side"), order.alias("_order"))

    # Side 0 runs backwards and holds its own time, side 1 runs forwards and does not.
    low, high = block(first), block(last)
    parts = F.array(
        part(low, 0, 1 - 2 * first),
        F.when(high - low > 1, part(low + 1, None, F.lit(None).cast("bigint"))),
        F.when(F.call_function("shiftleft", high, F.col("_level")) < last, part(high, 1, 2 * last)),
    )
    cut = bounded.withColumn("_part", F.explode(F.array_compact(parts))).select(*of_interval, "_level", "_part.*")

    used = bounded.agg(F.collect_set("_level").alias("levels")).scalar()
    points = (
        readings.select(
            *of_reading, micros(time).alias("_time"), F.lit(1).cast("bigint").alias("n"),
            *[F.col(value).alias(name) for name, value in sums.items()],
        )
        .where("_time IS NOT NULL")
        .withColumn("_level", F.explode(used))
        .withColumn("_block", block(F.col("_time")))
    )
    blocks = points.groupBy("_level", "_block", *of_reading).agg(*[F.sum(c).alias(c) for c in totals])
    met = cut.join(blocks, ["_level", "_block"])
    whole = met.where("_side IS NULL").select(*by, *totals)

    group = ["_level", "_block", *of_reading, "_side"]
    order = F.when(F.col("_side") == 0, -2 * F.col("_time")).otherwise(2 * F.col("_time") + 1)
    sided = points.withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_order", order)
    marks = met.where("_side IS NOT NULL").select(*of_interval, *group, "_order", F.lit(True).alias("_mark"))
    rows = sided.drop("_time").unionByName(marks, allowMissingColumns=True)
    shift = F.greatest(F.col("_level") + 1 - PART_BITS, F.lit(0))
    rows = rows.withColumn("_part", F.call_function("shiftright", "_order", shift))
    # What the earlier parts hold stands before the rows of each part.
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*group, "_part").agg(*[F.sum(c).alias(c) for c in totals]).select(
        *group, "_part", F.lit(-(1 << 63)).cast("bigint").alias("_order"), *[F.sum(c).over(before).alias(c) for c in totals]
    )
    so_far = Window.partitionBy(*group, "_part").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    read = (
        rows.unionByName(carried, allowMissingColumns=True)
        .select(*by, "_mark", *[F.sum(c).over(so_far).alias(c) for c in totals])
        .where("_mark")
        .drop("_mark")
    )
    found = whole.unionByName(read).groupBy(*by).agg(*[F.sum(c).alias(c) for c in totals])
    return found.where("n > 0")


def interval_history(
    daily: DataFrame,
    intervals: DataFrame,
    entities: Sequence[str],
    cols: SensorColumns = STATIONS,
    features: Sequence[str] | None = None,
    history: int = HISTORY_DAYS,
) -> DataFrame:
    """Flat history block of every (interval, entity) that has all ``history`` days.

    An interval that ends before it starts holds no day. However long an interval is, at
    most one day more than ``history`` is collected per entity.
    """
    names = cols.tree_features if features is None else features
    bounds = intervals.where("start_date <= end_date").select("window_idx", "start_date", "end_date")
    days = keep_entities(daily, entities, cols).select(cols.entity, cols.date, *names)
    step = F.struct(F.col(cols.date), F.array(*[F.col(f) for f in names]).alias("step"))
    keys = ["window_idx", "start_date", "end_date", cols.entity]
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(cols.date))
    return (
        join_intervals(days, bounds, day_number(cols.date), day_number("start_date"), day_number("end_date"))
        .withColumn("_position", position)
        .where(F.col("_position") <= history + 1)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(step)).alias("_steps"))
        .filter(F.size("_steps") == history)
        .withColumn("x", flatten_block(F.transform("_steps", lambda s: s["step"])))
        .drop("_steps")
    )


def interval_truth(
    daily: DataFrame,
    intervals: DataFrame,
    entities: Sequence[str],
    cols: SensorColumns = STATIONS,
    history: int = HISTORY_DAYS,
    horizon: int = HORIZON_DAYS,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Event flags of the days after each interval, for every listed entity in the data.

    Only intervals for which some entity has a full history count; ``blocks``, the result
    of ``interval_history``, saves finding them again. An entity without all
    ``horizon`` days gets zeros, even if some of its days exist.
    """
    tested = keep_entities(daily, entities, cols)
    if blocks is None:
        blocks = interval_history(tested, intervals, entities, cols, (), history)
    usable = blocks.select("window_idx", "end_date").distinct()
    present = tested.select(cols.entity).distinct()
    grid = usable.withColumn(cols.entity, F.explode(F.array(*[F.lit(e) for e in entities]))).join(
        present, cols.entity, "left_semi"
    )
    observed = tested.select(cols.entity, cols.date, F.col(cols.flag).alias("_flag"))
    end = day_number("end_date")
    flags = F.transform(F.sort_array("_days"), lambda d: d["_flag"])
    found = (
        join_intervals(observed, usable, day_number(cols.date), end + 1, end + horizon)
        .groupBy("window_idx", cols.entity)
        .agg(
            F.count("_flag").alias("_found"),
            F.collect_list(F.struct(F.col(cols.date), F.col("_flag"))).alias("_days"),
        )
        .where(F.col("_found") == horizon)
        .select("window_idx", cols.entity, flags.alias("_flags"))
    )
    return grid.join(found, ["window_idx", cols.entity], "left").select(
        "window_idx", cols.entity, F.coalesce("_flags", zero_horizon(horizon)).alias("y_days")
    )
