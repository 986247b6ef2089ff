"""Table and score sinks, and the checks that guard them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauge_engine.columns import STATIONS, SensorColumns


def require_columns(df: DataFrame, all_of: Sequence[str] = (), any_of: Sequence[str] = ()) -> DataFrame:
    """Fail unless every column of ``all_of`` and one of ``any_of`` is present."""
    absent = [c for c in all_of if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    if any_of and not any(c in df.columns for c in any_of):
        raise ValueError(f"needs one of the columns: {', '.join(any_of)}")
    return df


def require_predictions(df: DataFrame) -> DataFrame:
    """The contract of a prediction table: ``id`` with ``y_prob`` or ``label``."""
    return require_columns(df, all_of=["id"], any_of=["y_prob", "label"])


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail when the table is empty; looks at one row only."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
    **options: str,
) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        # Full precision; the default pattern stops at milliseconds.
        writer = writer.options(
            header=True,
            timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
            timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
        )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.options(**options).save(path)


def store_by_entity(df: DataFrame, path: str, cols: SensorColumns = STATIONS) -> DataFrame:
    """Write readings in one folder per entity and read them back.

    Rows are gathered by entity first, so a folder has few files; a hot entity is split over
    several tasks while the job runs. It suits up to some thousands of entities.
    """
    gathered = df.hint("rebalance", cols.entity)
    write_table(gathered, path, "parquet", [cols.entity])
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def store_bucketed(df: DataFrame, table: str, by: str, order: str, buckets: int = 16) -> DataFrame:
    """Write a catalog table of one sorted file per bucket of ``by``, and read it.

    What groups or windows by ``by`` then needs no exchange, and frames ordered by ``order``
    no sort. A bucket is written by one task: it suits series, which have one row per entity
    and day, not raw readings.
    """
    spark = df.sparkSession
    # Lets plans use the order inside a bucket; Spark checks that it is a single file.
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    dealt = df.repartition(buckets, by)
    dealt.write.mode("overwrite").bucketBy(buckets, by).sortBy(by, order).saveAsTable(table)
    return spark.table(table)


def publish_predictions(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Check the contract, then write."""
    write_table(require_predictions(df), path, fmt, mode=mode)


def score_json(scores: DataFrame) -> DataFrame:
    """Each score row as one JSON text."""
    return scores.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_scores(scores: DataFrame, path: str, mode: str = "errorifexists") -> None:
    scores.write.mode(mode).option("ignoreNullFields", False).json(path)
