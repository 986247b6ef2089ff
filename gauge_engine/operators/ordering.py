"""Global order without a one-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A bucket holds about so many rows, so the number of buckets follows the table.
ROWS_PER_BUCKET = 1 << 16
# Beyond so many buckets they grow instead. A table of bucket totals has no more rows.
BUCKET_BITS = 16
MAX_BUCKETS = 1 << BUCKET_BITS
# Sampled keys per cut: buckets are then even to about a quarter.
SAMPLED_PER_CUT = 16
# Bucket totals are summed up in blocks of so many buckets first.
BLOCK_BUCKETS = 256


def _cuts(df: DataFrame, key: str, buckets: int | None, rows_per_bucket: int) -> DataFrame:
    """One row: the keys at which the key range is cut into buckets, as an array ``cuts``.

    The sketch is the set of keys whose hash is below a bound. Every task takes its own part
    of it and the parts merge by union, whatever the partitioning. The bound follows the row
    count, so the sketch has about ``SAMPLED_PER_CUT`` keys per cut.

    Both passes carry all columns of ``df``, so that they read the same shuffle as the rows
    themselves and the input is computed once.
    """
    whole_row = F.struct(key, *[c for c in df.columns if c != key])
    # A row whose hash is 0 is not counted; the count sets the balance only.
    counted = F.count(F.nullif(F.xxhash64(whole_row), F.lit(0).cast("bigint"))).alias("n")

    def wanted(n: Column) -> Column:
        return F.lit(buckets) if buckets else F.greatest(F.least(F.ceil(n / rows_per_bucket), F.lit(MAX_BUCKETS)), F.lit(1))

    n = df.agg(counted).scalar()
    share = F.coalesce(F.least(F.lit(1.0), SAMPLED_PER_CUT * wanted(n) / F.nullif(n, F.lit(0))), F.lit(1.0))
    # Inside the aggregate, where no optimiser moves it below the shuffle.
    taken = F.when(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share * (1 << 30), whole_row)
    sketch = df.agg(F.sort_array(F.collect_list(taken)).alias("rows"), counted)
    spaced = sketch.select(F.col(f"rows.{key}").alias("keys"), wanted(F.col("n")).cast("int").alias("buckets"))
    at = F.transform(
        F.sequence(F.lit(1), F.col("buckets") - 1),
        lambda i: F.get("keys", F.floor(i.cast("bigint") * F.size("keys") / F.col("buckets")).cast("int")),
    )
    return spaced.select(F.when(F.col("buckets") > 1, at).alias("cuts"))


def with_order_buckets(
    df: DataFrame,
    key: str,
    name: str = "_bucket",
    buckets: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add an order-preserving bucket number for a unique ``key``.

    The key range is cut by a mergeable sample sketch into ``buckets``, or into as many as
    ``rows_per_bucket`` asks for. Which keys are picked affects balance only, never a result;
    the pick is the same on every evaluation. Rows find their bucket by halving, one
    generated-code projection per bit.
    """
    if buckets is not None and not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must lie within 1 and {MAX_BUCKETS}, not {buckets}")
    cuts = _cuts(df, key, buckets, rows_per_bucket)
    searched = df.withColumns({"_cuts": cuts.scalar(), "_found": F.lit(0)})
    for bit in reversed(range(BUCKET_BITS if buckets is None else (buckets - 1).bit_length())):
        step = 2**bit
        # Behind the last cut there is none to pass.
        passed = F.get("_cuts", F.col("_found") + (step - 1)) <= F.col(key)
        searched = searched.withColumn("_found", F.col("_found") + F.when(passed, step).otherwise(0))
    # A generated column: rules that trace a join key to its source would write out the halving, whose
    # text doubles with every bit.
    return searched.select(*df.columns, F.explode(F.array("_found")).alias(name))


def running_before(value: str, order: str, *partition: str) -> Column:
    """Sum of ``value`` over the earlier rows of a partition."""
    w = Window.partitionBy(*partition) if partition else Window
    frame = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(frame), F.lit(0))


def with_earlier_buckets(totals: DataFrame, value: str, out: str, bucket: str = "_bucket") -> DataFrame:
    """Add the sum of ``value`` over all earlier buckets to a table of one row per bucket.

    In two levels: inside blocks of buckets, and over the blocks (at most MAX_BUCKETS /
    BLOCK_BUCKETS rows).
    """
    others = [c for c in totals.columns if c != bucket]
    rows = F.sort_array(F.collect_list(F.struct(bucket, *others)))
    block = F.floor(F.col(bucket) / BLOCK_BUCKETS).alias("_block")
    blocks = totals.groupBy(block).agg(rows.alias("_rows"), F.sum(value).alias("_whole"))
    placed = blocks.withColumn("_before", running_before("_whole", "_block"))
    zero = F.lit(0).cast(placed.schema["_whole"].dataType)

    def with_sum(row: Column, i: Column) -> Column:
        inside = F.aggregate(F.slice("_rows", 1, i), zero, lambda acc, r: acc + r[value])
        return F.struct(*[row[c].alias(c) for c in (bucket, *others)], (F.col("_before") + inside).alias(out))

    return placed.select(F.inline(F.transform("_rows", with_sum)))


def ordered_prefix(df: DataFrame, key: str, value: str, out: str, buckets: int | None = None) -> DataFrame:
    """``key, value`` and ``out``: the sum of ``value`` over all rows with a smaller ``key``.

    ``key`` must be unique. Sums run inside order buckets; the bucket totals are summed up in
    order and joined back.
    """
    placed = with_order_buckets(df.select(key, value), key, buckets=buckets)
    totals = with_earlier_buckets(placed.groupBy("_bucket").agg(F.sum(value).alias("_total")), "_total", "_earlier")
    return (
        placed.withColumn("_inside", running_before(value, key, "_bucket"))
        # At most MAX_BUCKETS rows by construction.
        .join(F.broadcast(totals.select("_bucket", "_earlier")), "_bucket")
        .select(key, value, (F.col("_earlier") + F.col("_inside")).alias(out))
    )


def entity_offsets(df: DataFrame, entity: str, out: str = "offset") -> DataFrame:
    """Rows held by all earlier entities, one row per entity."""
    counts = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_rows"))
    return ordered_prefix(counts, entity, "_rows", out).drop("_rows")


def with_dense_id(
    df: DataFrame, entity: str, order: Sequence[str], name: str = "id"
) -> DataFrame:
    """Dense 0-based id in (entity, order): position inside the entity plus its offset."""
    w = Window.partitionBy(entity).orderBy(*order)
    return (
        df.withColumn("_position", F.row_number().over(w) - 1)
        .join(
            entity_offsets(df, entity, "_offset").withColumnRenamed(entity, "_entity"),
            F.col(entity).eqNullSafe(F.col("_entity")),
        )
        .drop("_entity")
        .withColumn(name, (F.col("_offset") + F.col("_position")).cast("bigint"))
        .drop("_position", "_offset")
    )


def with_positional_id(
    df: DataFrame, order: Sequence[str], name: str = "id", buckets: int | None = None
) -> DataFrame:
    """Dense 0-based id in ascending order of columns, nulls first.

    Position inside an order bucket plus the rows of all earlier buckets. ``order`` must
    determine the order completely.
    """
    placed = with_order_buckets(df.withColumn("_key", F.struct(*order)), "_key", buckets=buckets)
    totals = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    # At most MAX_BUCKETS rows by construction.
    offsets = F.broadcast(with_earlier_buckets(totals, "_rows", "_earlier").select("_bucket", "_earlier"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key")) - 1
    return (
        placed.withColumn("_position", inside)
        .join(offsets, "_bucket")
        .select((F.col("_earlier") + F.col("_position")).cast("bigint").alias(name), *df.columns)
    )
