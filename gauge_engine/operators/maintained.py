"""Daily series kept up to date from batches of readings.

The store holds the moments of every entity and day, in one folder per day. A batch rewrites the
days it touches and no others, however late its readings are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gauge_engine.columns import STATIONS, THRESHOLD_STDS, SensorColumns
from gauge_engine.operators.daily import READING_COUNT, READING_SQUARES, daily_rollup
from gauge_engine.operators.thresholds import reading_thresholds
from gauge_engine.session import materialize

BATCH = "batch"


def merged_moments(parts: DataFrame, cols: SensorColumns = STATIONS) -> DataFrame:
    """One row per entity and day from partial moments of it.

    Means are weighted by their counts; squares about the parts' means become squares about
    the common one, so nothing cancels.
    """
    count, value = F.col(READING_COUNT), F.col(cols.value)
    rows = F.sum(count)
    part = F.struct(count.alias("n"), value.alias("mean"))
    grouped = parts.groupBy(cols.entity, cols.date).agg(
        (F.sum(count * value) / F.nullif(rows, F.lit(0))).alias(cols.value),
        F.max(cols.peak).alias(cols.peak),
        rows.alias(READING_COUNT),
        F.sum(READING_SQUARES).alias(READING_SQUARES),
        F.max(BATCH).alias(BATCH),
        F.collect_list(part).alias("_parts"),
    )

    def between(total, p):
        return total + F.coalesce(p["n"] * F.pow(p["mean"] - F.col(cols.value), 2), F.lit(0.0))

    squares = F.col(READING_SQUARES) + F.aggregate("_parts", F.lit(0.0), between)
    return grouped.withColumn(READING_SQUARES, squares).drop("_parts")


@dataclass
class DailyStore:
    """Daily moments at ``path``. Batches carry rising numbers; one that is applied again, as
    after a failure half way, changes only what it had not reached."""

    spark: SparkSession
    path: str
    cols: SensorColumns = STATIONS

    def schema(self, entity: T.DataType) -> T.StructType:
        c = self.cols
        double, number = T.DoubleType(), T.LongType()
        fields = [(c.entity, entity), (c.value, double), (c.peak, double), (READING_COUNT, number), (READING_SQUARES, double), (BATCH, number), (c.date, T.DateType())]
        return T.StructType([T.StructField(n, t) for n, t in fields])

    def daily(self, entity: T.DataType = T.StringType()) -> DataFrame:
        """The series as ``daily_rollup(..., moments=True)`` of all readings would give it."""
        return self._stored(entity).drop(BATCH)

    def _stored(self, entity: T.DataType) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], self.schema(entity))
        return self.spark.read.schema(self.schema(entity)).parquet(self.path)

    def _exists(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def touched(self, rolled: DataFrame) -> DataFrame:
        """Stored rows of the days in ``rolled``; other days' folders are not read."""
        c = self.cols
        # At most one row per calendar day. The comparison tells the optimiser that pruning pays.
        days = F.broadcast(rolled.select(c.date).where(F.col(c.date) >= "0001-01-01").distinct())
        return self._stored(rolled.schema[c.entity].dataType).join(days, c.date, "left_semi")

    def refresh(self, readings: DataFrame, batch: int) -> None:
        """Merge a batch of readings into their days."""
        c = self.cols
        rolled = daily_rollup(readings, c, attrs=(), moments=True).withColumn(BATCH, F.lit(batch).cast("bigint"))
        rolled = materialize(rolled.select(*[f.name for f in self.schema(T.StringType())]), "batch-days")
        stored = self.touched(rolled)
        # What already holds this batch stays as it is.
        done = stored.where(F.col(BATCH) >= batch).select(c.entity, c.date)
        new = rolled.join(done, [c.entity, c.date], "left_anti")
        merged = materialize(merged_moments(stored.unionByName(new), c), "merged-days")
        writer = merged.select(*stored.columns).hint("rebalance", c.date).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(c.date).parquet(self.path)

    def thresholds(self, stds: float = THRESHOLD_STDS, entity: T.DataType = T.StringType()) -> DataFrame:
        """Reading-level thresholds from the stored moments."""
        return reading_thresholds(self.daily(entity), self.cols, stds)
