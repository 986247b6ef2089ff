"""The shape of the physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from gauge_engine.catalog.stand_ins import EVENTS, EVENTS_TRAIN, ORDERS, event_readings, order_readings
from gauge_engine.operators.daily import daily_slim, preview_per_key
from gauge_engine.operators.metrics import roc_auc, score_histogram, scored_pairs
from gauge_engine.operators.models import BoostingSettings, fit_horizon, score_horizon
from gauge_engine.operators.splits import keep_entities
from gauge_engine.plans.training import scoring_windows, training_windows

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_training_windows_scan_once_and_shuffle_twice(spark):
    text = plan(training_windows(order_readings(spark, SF), ORDERS, ORDERS.sequence_features))
    assert text.count("FileScan") == 1
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2
    assert "partial_avg" in text and "Join" not in text
    # One sort by entity and day serves every frame.
    assert text.count("Sort [") == 1


def test_only_needed_columns_and_pushed_entity_filter(spark):
    text = plan(daily_slim(keep_entities(event_readings(spark, SF), EVENTS_TRAIN, EVENTS), EVENTS))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text
    assert "PushedFilters: [In(event_type" in text


def test_date_range_reaches_the_scan(spark):
    text = plan(event_readings(spark, SF).filter(F.col("ts").between("2024-01-05", "2024-01-09")))
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text


@pytest.mark.parametrize("name", ["scores", "index_ids", "split_stratified", "interval_hist", "index_align"])
def test_no_cross_joins(spark, name):
    from gauge_engine.catalog import QUERIES

    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_horizon_scoring_adds_no_shuffle(spark):
    readings = order_readings(spark, SF)
    model = fit_horizon(training_windows(readings, ORDERS), BoostingSettings(rounds=1, depth=1))
    windows = scoring_windows(readings, ORDERS)
    scored = score_horizon(model, windows, ORDERS)
    assert plan(scored).count("Exchange") == plan(windows).count("Exchange") == 2
    assert scored.count() == windows.count()


def test_previews_are_limited_before_the_shuffle(spark):
    text = plan(preview_per_key(event_readings(spark, SF), EVENTS))
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_score_input_is_read_once(spark):
    """Bucket cuts and rows share one shuffle of the histogram."""
    pairs = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr(
        "CAST(l_returnflag = 'R' AS INT) AS y_true", "l_extendedprice AS score"
    )
    auc = roc_auc(score_histogram(pairs))
    auc.collect()
    assert "ReusedExchange" in plan(auc)


def test_a_hot_id_is_split_by_the_skew_join(spark):
    """A third of both tables sits on one id, with different scores."""
    rows = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id"),
        (F.col("id") % 2).cast("int").alias("y_true"),
        (F.col("id") / 300_000).alias("y_prob"),
    )
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        # Several input files, as a hot partition is split along the map tasks.
        pairs = scored_pairs(rows.select("id", "y_true"), rows.select("id", "y_prob").repartition(8))
        assert len(pairs.collect()) == 2 * 100_000 + 200_000
        assert "skew=true" in plan(pairs)
    finally:
        for key in small:
            spark.conf.unset(key)
