"""Inputs that must fail or be set aside instead of dropping out, and order-independence."""

import datetime as dt

import pytest
from fixtures import S, days
from pyspark.sql import functions as F

from gauge_engine.columns import SensorColumns
from gauge_engine.operators.daily import daily_rollup
from gauge_engine.operators.intervals import interval_history
from gauge_engine.operators.logs import early_stop
from gauge_engine.operators.metrics import confusion, counts_where, score_histogram, score_row, scored_pairs, scores_by_group
from gauge_engine.operators.models import chosen_rounds
from gauge_engine.operators.ordering import with_positional_id
from gauge_engine.operators.splits import split_tail
from gauge_engine.sources.readers import read_predictions, read_readings, read_readings_checked

HEADER = "time,station_name,latitude,longitude,sea_level\n"
GOOD = "2020-01-01 00:00:00,a,1.0,2.0,3.5\n"


def folder(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return str(tmp_path)


def test_a_file_with_another_header_fails(spark, tmp_path):
    other = "station_name,time,latitude,longitude,sea_level\na,2020-01-01 00:00:00,1.0,2.0,3.5\n"
    with pytest.raises(Exception, match="header"):
        read_readings(spark, folder(tmp_path, a=HEADER + GOOD, b=other)).collect()


@pytest.mark.parametrize("bad", ["01/02/2020 00:00,a,1.0,2.0,3.5\n", "2020-01-01 00:00:00,a,1.0,2.0,abc\n"])
def test_unreadable_readings_fail_or_are_set_aside(spark, tmp_path, bad):
    path = folder(tmp_path, a=HEADER + GOOD + bad)
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_readings(spark, path).collect()
    good, quarantine = read_readings_checked(spark, path)
    assert [r.sea_level for r in good.collect()] == [3.5]
    assert [r.bad_line for r in quarantine.collect()] == [bad.strip()]


def test_prediction_ids_may_be_whole_floats_only(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    got = read_predictions(spark, folder(tmp_path / "a", p="id,y_prob\n0.0,0.5\n7,0.25\n"))
    assert sorted(r.id for r in got.collect()) == [0, 7]
    with pytest.raises(Exception, match="not a whole number"):
        read_predictions(spark, folder(tmp_path / "b", p="id,y_prob\nx7,0.5\n")).collect()


def test_labels_other_than_0_and_1_fail(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (1, 1, 0.9), (2, 2, 0.5)], "id long, y_true int, y_prob double")
    predictions = df.select("id", "y_prob")
    tables = [
        score_row(score_histogram(scored_pairs(df.select("id", "y_true"), predictions), weight="weight")),
        confusion(df, "y_prob", "y_true"),
        scores_by_group(df, "id", "y_prob", "y_true"),
    ]
    for table in tables:
        with pytest.raises(Exception, match="neither 0 nor 1"):
            table.collect()


def test_reversed_intervals_have_no_block(spark):
    rows = [("a", d, float(i)) for i, d in enumerate(days(20))]
    daily = spark.createDataFrame(rows, "station_name string, date date, level double")
    first, last = days(20)[2], days(20)[8]
    intervals = spark.createDataFrame([(0, first, last), (1, last, first), (2, first, last)], "window_idx int, start_date date, end_date date")
    got = interval_history(daily, intervals, ["a"], S, ["level"])
    assert sorted(r.window_idx for r in got.collect()) == [0, 2]


def test_carried_attributes_do_not_depend_on_partitions(spark):
    at = dt.datetime(2020, 1, 1)
    cols = SensorColumns("k", "at", "v", ("attr",))
    rows = spark.createDataFrame([("a", at, 1.0, i) for i in range(40)], "k string, at timestamp, v double, attr int")
    assert {daily_rollup(rows.repartition(n), cols).first().attr for n in (1, 3, 7)} == {0}


def test_positional_ids_are_own_counts(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    df = spark.range(2000).select((F.col("id") * 37 % 2003).alias("v")).repartition(5)
    got = {r.v: r.id for r in with_positional_id(df, ["v"]).collect()}
    assert [got[v] for v in sorted(got)] == list(range(2000))


def test_null_entities_keep_their_rows(spark):
    df = spark.createDataFrame([(s, d) for s in ("a", None) for d in days(5)], "station_name string, hist_start date")
    assert split_tail(df, ["hist_start"], cols=S).count() == 10


def test_rounds_are_searched_to_the_end(spark):
    aucs = [0.8, 0.7, 0.6, 0.7, 0.9, 0.85]
    log = spark.createDataFrame([(i, a, 1 - a) for i, a in enumerate(aucs)], "iter int, AUC double, Logloss double")
    assert chosen_rounds(log) == 5 and chosen_rounds(log, "Logloss") == 5
    assert chosen_rounds(log, patience=2) == 1
    run = log.withColumn("run", F.lit(0))
    stopped = early_stop(run, "run", metric="AUC", patience=2, larger_is_better=True).first()
    assert (stopped.stop_iter, stopped.best_iter, stopped.best_value) == (2, 0, 0.8)


def test_counts_from_one_scan(spark):
    got = counts_where(spark.range(10), even=F.col("id") % 2 == 0, all=F.lit(True)).collect()
    assert {(r.table, r.rows) for r in got} == {("even", 5), ("all", 10)}
