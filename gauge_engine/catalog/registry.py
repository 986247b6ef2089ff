"""Registration of queries and the common output form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Added before rounding on both sides: an exact half then rounds up whatever the last
# bit of a floating-point sum happens to be.
NUDGE = 3e-9


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.replace("round(", f"round({NUDGE} + ")
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emit(df: DataFrame, digits: int = 4) -> DataFrame:
    """Comparable output: rounded doubles, ISO text for dates, times and integer arrays."""

    def plain(field: T.StructField) -> F.Column:
        c = F.col(field.name)
        match field.dataType:
            case T.DoubleType() | T.FloatType():
                c = F.round(c.cast("double") + NUDGE, digits)
            case T.DateType():
                c = F.date_format(c, "yyyy-MM-dd")
            case T.TimestampType() | T.TimestampNTZType():
                c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
            case T.ArrayType():
                c = F.array_join(c.cast("array<string>"), ",")
            case T.BooleanType():
                c = c.cast("int")
        return c.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def explode_block(df: DataFrame, block: str = "x") -> DataFrame:
    """One row per position of a numeric array."""
    others = [c for c in df.columns if c != block]
    return df.select(*others, F.posexplode(block).alias("pos", "x"))
