"""Scores of predictions against truth."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gauge_engine.catalog.horizon import _SCORES_SQL
from gauge_engine.catalog.registry import emit, query, table
from gauge_engine.functions.scalars import binarize
from gauge_engine.operators.metrics import confusion, roc_auc, score_column, score_histogram, scores_by_group
from gauge_engine.plans.evaluate import score_predictions
from gauge_engine.session import scratch_path
from gauge_engine.sources.sinks import write_scores


def _line_id():
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")


def _returned():
    return (F.col("l_returnflag") == "R").cast("int").alias("y_true")


def line_truth(spark, sf):
    return table(spark, sf, "lineitem").select(_line_id(), _returned())


def line_predictions(spark, sf):
    return table(spark, sf, "lineitem").select(_line_id(), (F.col("l_discount") * 10).alias("y_prob"))


def _pairs(spark, sf):
    """Truth and score side by side."""
    return table(spark, sf, "lineitem").select(
        "l_linenumber",
        _returned(),
        (F.col("l_discount") * 10).alias("y_prob"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
    )


_PAIRS = """WITH p AS (SELECT l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_discount * 10 AS s,
  CAST(l_discount * 10 >= 0.5 AS INTEGER) AS d, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem)"""

# The same through a join on the id, which repeats: every pair with the same id counts.
_JOINED = """WITH lines AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_returnflag = 'R' AS INTEGER) AS y,
  l_discount * 10 AS s FROM lineitem),
p AS (SELECT t.y, q.s, CAST(q.s >= 0.5 AS INTEGER) AS d FROM lines t JOIN lines q ON t.id = q.id)"""


def _auc_sql(score: str) -> str:
    return f""", ranked AS (SELECT y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS r FROM p),
area AS (SELECT (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE y = 1)::DOUBLE * count(*) FILTER (WHERE y = 0)) AS auc FROM ranked)"""


_ROW_SQL = """
SELECT round(auc, 6) AS auc, round((tp + tn) / n::DOUBLE, 6) AS acc, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1,
  round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc,
  CAST(n AS BIGINT) AS n
FROM area CROSS JOIN (SELECT count(*) AS n, count(*) FILTER (WHERE y = 0 AND d = 0) AS tn,
  count(*) FILTER (WHERE y = 0 AND d = 1) AS fp, count(*) FILTER (WHERE y = 1 AND d = 0) AS fn,
  count(*) FILTER (WHERE y = 1 AND d = 1) AS tp FROM p)"""


@query("auc", _PAIRS + _auc_sql("s") + "SELECT round(auc, 6) AS auc FROM area")
def _(spark, sf):
    return emit(roc_auc(score_histogram(_pairs(spark, sf), "y_prob")), 6)


@query("auc_bucketed", _PAIRS + _auc_sql("revenue") + "SELECT round(auc, 6) AS auc FROM area")
def _(spark, sf):
    return emit(roc_auc(score_histogram(_pairs(spark, sf), "revenue"), buckets=64), 6)


@query("scores", _JOINED + _auc_sql("s") + _ROW_SQL)
def _(spark, sf):
    return emit(score_predictions(line_truth(spark, sf), line_predictions(spark, sf)), 6)


@query("score_json", _JOINED + _auc_sql("s") + _ROW_SQL)
def _(spark, sf):
    path = scratch_path(spark, "scores")
    write_scores(score_predictions(line_truth(spark, sf), line_predictions(spark, sf)), path)
    return emit(spark.read.schema("auc double, acc double, f1 double, mcc double, n bigint").json(path), 6)


@query(
    "confusion",
    _PAIRS
    + """SELECT count(*) FILTER (WHERE y = 0 AND d = 0) AS tn, count(*) FILTER (WHERE y = 0 AND d = 1) AS fp,
           count(*) FILTER (WHERE y = 1 AND d = 0) AS fn, count(*) FILTER (WHERE y = 1 AND d = 1) AS tp FROM p""",
)
def _(spark, sf):
    return confusion(_pairs(spark, sf), "y_prob", "y_true")


@query(
    "binarize",
    """SELECT l_orderkey, l_linenumber, CAST(l_discount * 10 >= 0.5 AS INTEGER) AS at_least,
         CAST(l_discount * 10 > 0.5 AS INTEGER) AS above FROM lineitem""",
)
def _(spark, sf):
    score = F.col("l_discount") * 10
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        binarize(score).alias("at_least"),
        binarize(score, strict=True).alias("above"),
    )


@query(
    "score_col_fallback",
    """SELECT l_orderkey * 10 + l_linenumber AS id, 'y_prob' AS kind, l_discount * 10 AS score FROM lineitem
       UNION ALL SELECT doc_id, 'label', CAST(quality AS DOUBLE) FROM labels
       UNION ALL SELECT vec_id, 'last', CAST(label AS DOUBLE) FROM embeddings""",
)
def _(spark, sf):
    def chosen(predictions, kind):
        score = F.col(score_column(predictions.columns)).cast("double")
        return predictions.select("id", F.lit(kind).alias("kind"), score.alias("score"))

    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.col("toxic").alias("other")
    )
    groups = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group"))
    out = chosen(line_predictions(spark, sf), "y_prob")
    return out.unionByName(chosen(labels, "label")).unionByName(chosen(groups, "last"))


@query(
    "scores_by_window",
    """WITH decided AS (SELECT l_linenumber AS g, CAST(l_returnflag = 'R' AS INTEGER) AS y,
         CAST(l_discount * 10 > 0.5 AS INTEGER) AS d FROM lineitem)"""
    + _SCORES_SQL,
)
def _(spark, sf):
    pairs = _pairs(spark, sf).withColumn("window_idx", F.col("l_linenumber").cast(T.IntegerType()))
    return emit(scores_by_group(pairs, "window_idx", "y_prob", "y_true"), 6)
