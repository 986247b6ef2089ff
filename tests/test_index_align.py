from datetime import timedelta

import pytest
from fixtures import S, START, days, reading, readings, series

from gauge_engine.operators.align import align_to_index, complete_predictions, constant_predictions
from gauge_engine.operators.daily import daily_slim
from gauge_engine.operators.index import index_with_ids
from gauge_engine.operators.ordering import ordered_prefix, with_positional_id
from gauge_engine.plans.training import scoring_windows
from pyspark.sql import functions as F


def test_index_bounds_and_dense_ids(spark):
    df = series(spark, "b", [1.0] * 25).unionByName(series(spark, "a", [1.0] * 22)).unionByName(series(spark, "c", [1.0] * 20))
    got = index_with_ids(daily_slim(df, S), S).orderBy("id").collect()
    assert [r.id for r in got] == list(range(7))
    assert [r.station_name for r in got] == ["a"] * 2 + ["b"] * 5
    first = got[0]
    assert first.hist_start == START and first.future_start == START + timedelta(days=7)
    assert first.hist_end == START + timedelta(days=6) and first.future_end == START + timedelta(days=20)


def test_gap_free_windows_all_match_and_gaps_default(spark):
    full = series(spark, "a", [float(i) for i in range(40)])
    holed = readings(spark, [reading("b", d, 1.0) for i, d in enumerate(days(40)) if i not in (10, 11, 12)])
    df = full.unionByName(holed)
    index = index_with_ids(daily_slim(df, S), S)
    predictions = scoring_windows(df, S).withColumn("y_prob", F.lit(0.9))
    got = align_to_index(index, predictions, S).join(index, "id").collect()
    assert {r.y_prob for r in got if r.station_name == "a"} == {0.9}
    holed_scores = {r.future_start: r.y_prob for r in got if r.station_name == "b"}
    assert set(holed_scores.values()) == {0.5, 0.9}
    assert holed_scores[days(40)[14]] == 0.5 and holed_scores[days(40)[25]] == 0.9


def test_complete_and_constant(spark):
    index = spark.range(4)
    some = spark.createDataFrame([(1, 0.2), (3, 0.7)], "id bigint, y_prob double")
    assert [tuple(r) for r in complete_predictions(index, some).orderBy("id").collect()] == [
        (0, 0.5), (1, 0.2), (2, 0.5), (3, 0.7)]
    assert {r.y_prob for r in constant_predictions(index).collect()} == {0.5}


@pytest.mark.parametrize("bits", [1, 3, 9])
def test_prefix_sums_for_any_number_of_buckets(spark, bits):
    df = spark.range(500).select(F.format_string("k%05d", F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 5).alias("v"))
    got = ordered_prefix(df, "k", "v", "before", bits).orderBy("k").collect()
    total = 0
    for r in got:
        assert r.before == total
        total += r.v
    assert len(got) == 500


def test_prefix_of_nothing(spark):
    assert ordered_prefix(spark.createDataFrame([], "k string, v bigint"), "k", "v", "before").count() == 0


def test_positional_id_follows_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(7)
    got = with_positional_id(df, ["v"]).collect()
    assert len(got) == 1000 and all(r.id == r.v for r in got)
