"""Training-metric logs: best iteration and where early stopping would have ended.

A run has one row per iteration, so its group is bounded by the number of iterations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gauge_engine.functions.scalars import null_if_nan


def best_iteration(
    log: DataFrame, run: str, iteration: str = "iter", metric: str = "AUC", larger_is_better: bool = True
) -> DataFrame:
    """Best value per run and its iteration, the earliest on ties."""
    value = null_if_nan(metric)
    ranked = F.when(
        value.isNotNull(),
        F.struct((value if larger_is_better else -value).alias("v"), (-F.col(iteration)).alias("earlier")),
    )
    return log.groupBy(run).agg(
        F.max_by(F.col(iteration), ranked).alias("best_iter"),
        F.max_by(value, ranked).alias("best_value"),
    )


def early_stop(
    log: DataFrame, run: str, iteration: str = "iter", metric: str = "Logloss", patience: int = 5,
    larger_is_better: bool = False,
) -> DataFrame:
    """Per run: the first iteration that is ``patience`` rows past a strict improvement.

    ``stop_iter`` is null when the run never stops early; ``best_iter`` and ``best_value``
    are the last improvement up to the stop.
    """
    order = Window.partitionBy(run).orderBy("_iter")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sign = -1 if larger_is_better else 1
    value = sign * null_if_nan(metric)
    entries = log.select(run, F.col(iteration).alias("_iter"), value.alias("_value"))
    marked = entries.withColumns(
        {"_row": F.row_number().over(order), "_least": F.min("_value").over(before)}
    )
    improved = F.col("_value").isNotNull() & (F.col("_least").isNull() | (F.col("_value") < F.col("_least")))
    waited = marked.withColumn("_improved", improved).withColumn(
        "_since",
        F.col("_row") - F.coalesce(F.max(F.when(F.col("_improved"), F.col("_row"))).over(so_far), F.lit(0)),
    )
    stopped = waited.withColumn(
        "_stop_row",
        F.min(F.when(F.col("_since") >= patience, F.col("_row"))).over(Window.partitionBy(run)),
    )
    ran = F.col("_stop_row").isNull() | (F.col("_row") <= F.col("_stop_row"))
    best_row = F.when(ran & F.col("_improved"), F.col("_row"))
    return stopped.groupBy(run).agg(
        F.max(F.when(F.col("_row") == F.col("_stop_row"), F.col("_iter"))).alias("stop_iter"),
        F.max_by("_iter", best_row).alias("best_iter"),
        (sign * F.max_by("_value", best_row)).alias("best_value"),
    )
