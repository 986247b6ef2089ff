"""File readers with declared schemas. NaN becomes null here, once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gauge_engine.columns import (
    INTERVALS_SCHEMA,
    METRIC_LOG_SCHEMA,
    PREDICTIONS_SCHEMA,
    STATIONS,
    TRUTH_SCHEMA,
    SensorColumns,
    index_schema,
    readings_schema,
)
from gauge_engine.functions.scalars import null_if_nan

# Column that holds an unreadable line.
BAD_LINE = "bad_line"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in every floating-point column."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({name: null_if_nan(name) for name in floating})


def _read_by_name(
    spark: SparkSession, path: str, declared: T.StructType, other: T.DataType | None = None, **options: str
) -> DataFrame:
    """CSV with a header in any column order; only the header line is looked at up front.

    Declared columns get their declared type. Others are left out, unless ``other`` is
    given: then the last of them gets that type and the rest stay text. A file of the
    folder whose header differs, and a value that is not of its type, fail the job.
    """
    reader = spark.read.options(header=True, **({"mode": "FAILFAST", "enforceSchema": "false"} | options))
    header = reader.csv(path).columns
    types = {f.name: f.dataType for f in declared.fields}
    unknown = [c for c in header if c not in types]
    types |= {c: T.StringType() for c in unknown[:-1]} | {c: other or T.StringType() for c in unknown[-1:]}
    df = reader.schema(T.StructType([T.StructField(c, types[c]) for c in header])).csv(path)
    return df if other else df.drop(*unknown)


def _read_apart(spark: SparkSession, path: str, declared: T.StructType) -> tuple[DataFrame, DataFrame]:
    """``(good, quarantine)``: typed rows, and the lines with a value that is not of its type."""
    reader = spark.read.options(header=True, enforceSchema="false")
    header = reader.csv(path).columns
    types = {f.name: f.dataType for f in declared.fields}
    fields = [T.StructField(c, types.get(c, T.StringType())) for c in header]
    schema = T.StructType([*fields, T.StructField(BAD_LINE, T.StringType())])
    rows = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_LINE).schema(schema).csv(path)
    known = [c for c in header if c in types]
    # The whole row is asked for: which lines are bad depends on the columns that are parsed.
    whole = rows.where(F.xxhash64(*header) != F.lit(0))
    good = whole.where(F.col(BAD_LINE).isNull()).select(*known)
    bad = whole.where(F.col(BAD_LINE).isNotNull()).select(BAD_LINE)
    return good, bad


def read_readings(
    spark: SparkSession,
    path: str,
    cols: SensorColumns = STATIONS,
    schema: T.StructType | None = None,
    fmt: str = "csv",
) -> DataFrame:
    declared = schema or readings_schema(cols)
    if fmt == "csv":
        return nan_to_null(_read_by_name(spark, path, declared))
    return nan_to_null(spark.read.schema(declared).format(fmt).load(path))


def read_readings_checked(
    spark: SparkSession, path: str, cols: SensorColumns = STATIONS, schema: T.StructType | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(readings, quarantine)``: lines with an unreadable value are set aside as text."""
    good, bad = _read_apart(spark, path, schema or readings_schema(cols))
    return nan_to_null(good), bad


def read_index(spark: SparkSession, path: str, cols: SensorColumns = STATIONS) -> DataFrame:
    return _read_by_name(spark, path, index_schema(cols))


def _lines_in_order(df: DataFrame, name: str) -> DataFrame:
    """Number rows from 0 in file order: by file, by offset in it, by line in the split.

    Rows are counted per split and the counts summed up in order, one row per split; no
    row of the files is moved.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
    )
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = placed.groupBy("_file", "_start").agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    offsets = splits.select("_file", "_start", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(offsets, ["_file", "_start"]).select(
        (F.col("_line") + F.col("_shift")).cast("bigint").alias(name), *df.columns
    )


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated intervals with US dates; ``window_idx`` keeps duplicates apart."""
    raw = _read_by_name(spark, path, INTERVALS_SCHEMA, sep="\t", dateFormat="M/d/yyyy")
    numbered = _lines_in_order(raw, "window_idx")
    return numbered.select(F.col("window_idx").cast("int").alias("window_idx"), "start_date", "end_date")


def read_entities(spark: SparkSession, path: str, cols: SensorColumns = STATIONS) -> DataFrame:
    """One-column entity list with a header."""
    schema = T.StructType([T.StructField(cols.entity, T.StringType())])
    return spark.read.schema(schema).option("header", True).csv(path)


def _whole_number(name: str) -> Column:
    """Text as a whole number, also when it is written like ``3.0``; anything else fails the job."""
    text = F.trim(name)
    whole = F.when(text.rlike(r"^[+-]?[0-9]+(\.0*)?$"), F.substring_index(text, ".", 1).cast("bigint"))
    return F.coalesce(whole, F.raise_error(F.concat(F.lit(f"{name} is not a whole number: "), F.coalesce(text, F.lit("null")))))


def _read_with_id(spark: SparkSession, path: str, declared: T.StructType) -> DataFrame:
    text_id = T.StructType([T.StructField(f.name, T.StringType() if f.name == "id" else f.dataType) for f in declared.fields])
    df = _read_by_name(spark, path, text_id, other=T.DoubleType())
    return df.withColumn("id", _whole_number("id")) if "id" in df.columns else _lines_in_order(df, "id")


def repair_truth(truth: DataFrame) -> DataFrame:
    """Project ``id, y_true``; without ``y_true`` the last other column takes its name."""
    if "y_true" not in truth.columns:
        last = [c for c in truth.columns if c != "id"][-1]
        truth = truth.withColumnRenamed(last, "y_true")
    return truth.select("id", "y_true")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth file of any column layout; ids are line positions when the file has none."""
    return repair_truth(_read_with_id(spark, path, TRUTH_SCHEMA)).withColumn("y_true", F.col("y_true").cast("int"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction file; a missing path fails, a missing id becomes the line position."""
    declared = T.StructType([*PREDICTIONS_SCHEMA.fields, T.StructField("label", T.IntegerType())])
    return nan_to_null(_read_with_id(spark, path, declared))


def read_truth_checked(
    spark: SparkSession, path: str, encoding: str = "ISO-8859-1", strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Truth with strict integers: ``(good, quarantine)``.

    Rows whose id or label is not an integer go to quarantine as text. ``strict`` makes
    them fail the job instead.
    """
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("y_true", T.StringType())])
    text = _read_by_name(spark, path, schema, encoding=encoding)
    if strict:
        cast = text.select(F.col("id").cast("bigint").alias("id"), F.col("y_true").cast("int").alias("y_true"))
        return cast, text.filter(F.lit(False))
    number, label = F.expr("try_cast(id AS BIGINT)"), F.expr("try_cast(y_true AS INT)")
    valid = number.isNotNull() & label.isNotNull()
    good = text.filter(valid).select(number.alias("id"), label.alias("y_true"))
    return good, text.filter(~valid)


def read_metric_log(
    spark: SparkSession, path: str, schema: T.StructType = METRIC_LOG_SCHEMA
) -> DataFrame:
    """Tab-separated training log, one row per iteration."""
    return _read_by_name(spark, path, schema, sep="\t")
