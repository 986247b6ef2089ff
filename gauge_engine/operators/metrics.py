"""Class balance and binary scores.

Everything is derived from counts per distinct score, so copies of a score collapse
before the shuffle and no step sorts the scored rows themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gauge_engine.columns import DECISION_CUTOFF
from gauge_engine.functions.scalars import binarize, null_if_nan
from gauge_engine.operators.ordering import running_before, with_earlier_buckets, with_order_buckets


_CELLS = ("tn", "fp", "fn", "tp")


def _count_where(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("bigint"))


def class_balance(df: DataFrame, label: str = "y") -> DataFrame:
    """Positives, negatives, positive share and the weight that balances the positives."""
    y = F.col(label)
    return (
        df.agg(_count_where(y == 1).alias("pos"), _count_where(y == 0).alias("neg"), F.avg(y).alias("rate"))
        .withColumn("weight", F.col("neg").cast("double") / F.greatest(F.col("pos"), F.lit(1)))
    )


def label_balance(windows: DataFrame, labels: str = "y_days") -> DataFrame:
    """The same over every cell of the horizon label matrix."""
    return class_balance(windows.select(F.explode(labels).alias("_cell")), "_cell")


def score_column(columns: Sequence[str]) -> str:
    """Which prediction column carries the score: y_prob, else label, else the last one."""
    for name in ("y_prob", "label"):
        if name in columns:
            return name
    return list(columns)[-1]


def _required(name: str, dtype: str | None = None) -> Column:
    """The column, failing the job where it is null (an unreadable truth row)."""
    c = F.col(name).cast(dtype) if dtype else F.col(name)
    return F.coalesce(c, F.raise_error(F.lit(f"truth row without a usable {name}"))).alias(name)


def binary_label(label: str) -> Column:
    """The label as 0 or 1; a null or any other value fails the job instead of dropping out."""
    y = F.col(label).cast("double")
    return F.when(y.isin(0.0, 1.0), y.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit(f"{label} is neither 0 nor 1: "), F.coalesce(y.cast("string"), F.lit("null"))))
    )


def scored_pairs(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Truth joined to predictions on id: ``score``, ``y_true`` and a row ``weight``.

    Copies in the truth are counted before the join, so repeated ids on both sides do not
    multiply; the weight restores their number. A truth row without id or with a label
    other than 0 and 1 fails the job; set such rows aside beforehand to go on without them.
    """
    name = score_column(predictions.columns)
    score = F.col(name).cast("int" if name == "label" else "double")
    usable = truth.select(_required("id"), _required("y_true", "int"))
    usable = usable.withColumn("y_true", binary_label("y_true"))
    counted = usable.groupBy("id", "y_true").agg(F.count(F.lit(1)).alias("weight"))
    return predictions.select("id", score.cast("double").alias("score")).join(counted, "id")


def score_histogram(pairs: DataFrame, score: str = "score", label: str = "y_true", weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score; a missing score ranks below all."""
    rows = F.col(weight) if weight else F.lit(1).cast("bigint")
    y = binary_label(label)
    ranked = F.coalesce(null_if_nan(score), F.lit(float("-inf")))
    return pairs.groupBy(ranked.alias("score")).agg(
        F.sum(F.when(y == 1, rows).otherwise(0)).alias("pos"),
        F.sum(F.when(y == 0, rows).otherwise(0)).alias("neg"),
    )


def _totals(histogram: DataFrame, cutoff: float, buckets: int | None) -> DataFrame:
    """One row: confusion counts, won pairs (ties half) and unusable scores.

    Won pairs are counted inside order buckets first; each bucket then adds its positives
    times the negatives of all earlier buckets.
    """
    hit = F.col("score") >= cutoff
    inside = F.col("pos").cast("double") * (F.col("_below") + F.col("neg") / 2)
    each = (
        with_order_buckets(histogram, "score", buckets=buckets)
        .withColumn("_below", running_before("neg", "score", "_bucket"))
        .groupBy("_bucket")
        .agg(
            F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"),
            F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"),
            F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(inside).alias("_wins"),
            _count_where(F.abs("score") == float("inf")).alias("_unusable"),
        )
        .withColumn("_neg", F.col("tn") + F.col("fp"))
    )
    across = (F.col("fn") + F.col("tp")).cast("double") * F.col("_earlier")
    return with_earlier_buckets(each, "_neg", "_earlier").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _CELLS],
        F.sum(F.col("_wins") + across).alias("wins"),
        F.sum("_unusable").alias("unusable"),
    )


def _area(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    pairs = (tp + fn).cast("double") * (tn + fp).cast("double")
    undefined = (F.col("unusable") > 0) | (pairs == 0)
    return F.when(undefined, F.lit(0.5)).otherwise(F.col("wins") / F.nullif(pairs, F.lit(0.0)))


def roc_auc(histogram: DataFrame, buckets: int | None = None) -> DataFrame:
    """Area under the ROC curve; 0.5 when one class or any score is missing."""
    cells = [F.col(c) for c in _CELLS]
    return _totals(histogram, DECISION_CUTOFF, buckets).select(_area(*cells).alias("auc"))


def confusion_counts(y_true: Column, y_pred: Column, weight: Column | None = None) -> dict[str, Column]:
    """Aggregates tn, fp, fn, tp."""
    rows = F.lit(1).cast("bigint") if weight is None else weight

    def cell(truth: int, decision: int) -> Column:
        hit = (y_true == truth) & (y_pred == decision)
        return F.coalesce(F.sum(F.when(hit, rows)), F.lit(0)).cast("bigint")

    return {"tn": cell(0, 0), "fp": cell(0, 1), "fn": cell(1, 0), "tp": cell(1, 1)}


def accuracy(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    return (tp + tn) / F.nullif(tn + fp + fn + tp, F.lit(0))


def f1(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    """0 when there is neither a positive nor a positive decision."""
    return F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))


def matthews(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    """Matthews correlation in doubles (the product of four counts overflows integers)."""
    tn, fp, fn, tp = (c.cast("double") for c in (tn, fp, fn, tp))
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.coalesce((tp * tn - fp * fn) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))


def confusion(df: DataFrame, score: str, label: str, cutoff: float = DECISION_CUTOFF, strict: bool = False) -> DataFrame:
    """One row with the four confusion counts at a cut-off."""
    cells = confusion_counts(binary_label(label), binarize(score, cutoff, strict))
    return df.agg(*[c.alias(name) for name, c in cells.items()])


def score_row(
    histogram: DataFrame, cutoff: float = DECISION_CUTOFF, buckets: int | None = None, allow_empty: bool = False
) -> DataFrame:
    """One row ``auc, acc, f1, mcc, n`` from a score histogram.

    An empty one fails, or with ``allow_empty`` gives n = 0, an AUC of 0.5, no accuracy, and 0
    for the others.
    """
    tn, fp, fn, tp = (F.col(c) for c in _CELLS)
    n = tn + fp + fn + tp
    none = F.lit(0) if allow_empty else F.raise_error(F.lit("no overlapping ids between truth and predictions"))
    checked = F.when(n > 0, n).otherwise(none)
    return _totals(histogram, cutoff, buckets).select(
        _area(tn, fp, fn, tp).alias("auc"),
        accuracy(tn, fp, fn, tp).alias("acc"),
        f1(tn, fp, fn, tp).alias("f1"),
        matthews(tn, fp, fn, tp).alias("mcc"),
        checked.cast("bigint").alias("n"),
    )


def scores_by_group(
    df: DataFrame, group: str, score: str, label: str, cutoff: float = DECISION_CUTOFF, strict: bool = True
) -> DataFrame:
    """Confusion counts and scores per group, plus one row (null group) over everything, also
    where there are no rows. The total is summed up from the groups."""
    cells = confusion_counts(binary_label(label), binarize(score, cutoff, strict))
    groups = df.groupBy(group).agg(*[c.alias(name) for name, c in cells.items()])
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in _CELLS])
    counts = groups.unionByName(total, allowMissingColumns=True)
    tn, fp, fn, tp = (F.col(c) for c in _CELLS)
    return counts.select(
        group,
        *_CELLS,
        accuracy(tn, fp, fn, tp).alias("acc"),
        f1(tn, fp, fn, tp).alias("f1"),
        matthews(tn, fp, fn, tp).alias("mcc"),
    )


def run_summary(**tables: DataFrame) -> DataFrame:
    """Row count of each named table, by scanning it.

    A table that is written or scored anyway is counted on the way by ``CountedTables``;
    filters of one table are counted in one scan by ``counts_where``.
    """
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class CountedTables:
    """Row counts as by-products of plans that run anyway.

    ``counted`` hangs an observation on a table; once an action has run the plan, ``summary``
    gives ``table, rows`` without another scan. Rows are counted where the observation
    stands in the plan: put it behind the filters whose rows are meant, and run each counted
    table in one action that reads it whole (a limit or a pruned branch would be counted as such).
    """

    def __init__(self) -> None:
        self._observed: dict[str, tuple[Observation, str]] = {}

    def counted(self, name: str, df: DataFrame, **conditions: Column) -> DataFrame:
        """``df``, counted under ``name`` when it runs, and under each of ``conditions``."""
        observation = Observation()
        wanted = {name: F.count(F.lit(1))} | {c: _count_where(k) for c, k in conditions.items()}
        metrics = [F.coalesce(value, F.lit(0)).cast("bigint").alias(f"rows_{k}") for k, value in enumerate(wanted.values())]
        for k, table in enumerate(wanted):
            if table in self._observed:
                raise ValueError(f"table {table} is counted twice")
            self._observed[table] = (observation, f"rows_{k}")
        return df.observe(observation, *metrics)

    def rows(self, name: str) -> int:
        """The count of a table; waits for the action that runs it."""
        observation, metric = self._observed[name]
        return observation.get[metric]

    def summary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(name, self.rows(name)) for name in self._observed], "table string, rows bigint")


def counts_where(df: DataFrame, **conditions: Column) -> DataFrame:
    """``table, rows``: rows of ``df`` that meet each named condition, from one scan."""
    counted = df.agg(*[_count_where(condition).alias(name) for name, condition in conditions.items()])
    pairs = [F.struct(F.lit(name).alias("table"), F.col(name).alias("rows")) for name in conditions]
    return counted.select(F.inline(F.array(*pairs)))
