import pytest
from fixtures import NAN, S, days, reading, readings
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gauge_engine.functions.scalars import daynum_to_timestamp
from gauge_engine.plans.prepare import prepare_dataset
from gauge_engine.sources.matrix import melt_matrix
from gauge_engine.sources.readers import (
    read_entities,
    read_index,
    read_intervals,
    read_metric_log,
    read_predictions,
    read_readings,
    read_truth,
    read_truth_checked,
    repair_truth,
)
from gauge_engine.sources.sinks import (
    publish_predictions,
    require_columns,
    require_predictions,
    require_rows,
    write_scores,
    write_table,
)


def text(path, body, encoding="utf-8"):
    path.write_bytes(body.encode(encoding))
    return str(path)


def test_readings_by_name_with_nan(spark, tmp_path):
    path = text(
        tmp_path / "r.csv",
        "station_name,time,sea_level,extra,latitude,longitude\n"
        "a,2020-01-01 00:00:00,1.5,x,1,2\na,2020-01-01 01:00:00.000003,NaN,x,1,2\na,2020-01-01 02:00:00,,x,,2\n",
    )
    got = read_readings(spark, path).orderBy("time").collect()
    assert [r.sea_level for r in got] == [1.5, None, None]
    assert got[1].time.microsecond == 3 and got[2].latitude is None
    assert "extra" not in got[0].asDict()


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_readings_round_trip_by_station(spark, tmp_path, fmt):
    df = readings(spark, [reading(s, d, NAN if s == "b" else 2.0) for s in "ab" for d in days(3)])
    write_table(df, str(tmp_path / "t"), fmt, ["station_name"])
    back = read_readings(spark, str(tmp_path / "t"), fmt=fmt)
    assert back.count() == 6 and back.filter("sea_level IS NULL").count() == 3


def test_index_dates(spark, tmp_path):
    path = text(
        tmp_path / "i.csv",
        "id,station_name,hist_start,hist_end,future_start,future_end\n0,a,2020-01-01,2020-01-07,2020-01-08,2020-01-21\n",
    )
    row = read_index(spark, path).first()
    assert row.id == 0 and str(row.hist_start) == "2020-01-01" and str(row.future_end) == "2020-01-21"


def test_intervals_keep_duplicates_in_file_order(spark, tmp_path):
    path = text(tmp_path / "s.txt", "start_date\tend_date\r\n5/13/2011\t5/19/2011\r\n12/31/2009\t1/6/2010\r\n5/13/2011\t5/19/2011\r\n")
    got = read_intervals(spark, path).orderBy("window_idx").collect()
    assert [(r.window_idx, str(r.start_date), str(r.end_date)) for r in got] == [
        (0, "2011-05-13", "2011-05-19"), (1, "2009-12-31", "2010-01-06"), (2, "2011-05-13", "2011-05-19")]


def test_entity_list(spark, tmp_path):
    path = text(tmp_path / "e.txt", "station_name\nLewes\nThe_Battery")
    assert {r.station_name for r in read_entities(spark, path).collect()} == {"Lewes", "The_Battery"}


def test_truth_without_id_or_name(spark, tmp_path):
    path = text(tmp_path / "y.csv", "first,flooded\n9,1\n9,0\n9,1\n")
    assert [tuple(r) for r in read_truth(spark, path).orderBy("id").collect()] == [(0, 1), (1, 0), (2, 1)]
    named = spark.createDataFrame([(5, 1)], "id bigint, flooded int")
    assert repair_truth(named).columns == ["id", "y_true"]


def test_predictions_in_file_order_across_splits(spark, tmp_path):
    lines = [f"{i / 10000}" for i in range(10000)]
    path = text(tmp_path / "p.csv", "y_prob\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = read_predictions(spark, path)
        assert got.filter(F.abs(F.col("id") / 10000 - F.col("y_prob")) > 1e-12).count() == 0
        assert got.agg(F.countDistinct("id"), F.max("id")).first()[:] == (10000, 9999)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_missing_predictions_fail(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_predictions(spark, str(tmp_path / "absent.csv"))


def test_dirty_truth_goes_to_quarantine(spark, tmp_path):
    rows = "".join(f"{i},{0 if i == 13 else 1}\r\n" for i in range(21))
    path = text(tmp_path / "y.csv", "id,y_true\r\n" + rows + "ï¿,\r\nrow 181390,1\r\n", "iso-8859-1")
    good, bad = read_truth_checked(spark, path)
    assert good.count() == 21 and good.filter("y_true = 0").first().id == 13
    assert {r.id for r in bad.collect()} == {"ï¿", "row 181390"}
    strict, _ = read_truth_checked(spark, path, strict=True)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        strict.collect()


def test_metric_log(spark, tmp_path):
    path = text(tmp_path / "l.tsv", "iter\tAUC\tLogloss\n0\t0.84\t0.66\n1\t0.89\t0.41\n")
    assert [tuple(r) for r in read_metric_log(spark, path).orderBy("iter").collect()] == [(0, 0.84, 0.66), (1, 0.89, 0.41)]


def test_prediction_contract(spark, tmp_path):
    ids = spark.range(2)
    with pytest.raises(ValueError, match="one of"):
        require_predictions(ids)
    with pytest.raises(ValueError, match="missing"):
        require_columns(ids, ["id", "x"])
    require_predictions(ids.withColumn("label", F.lit(1)))
    publish_predictions(ids.withColumn("y_prob", F.lit(0.5)), str(tmp_path / "p"))
    assert read_predictions(spark, str(tmp_path / "p")).count() == 2
    with pytest.raises(ValueError, match="nothing"):
        require_rows(ids.filter("id < 0"), "nothing")


def test_scores_sink(spark, tmp_path):
    row = spark.createDataFrame([(0.5, None)], "auc double, mcc double")
    write_scores(row, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first().value == '{"auc":0.5,"mcc":null}'


def test_daynumbers(spark):
    df = spark.createDataFrame([(719529.0,), (712224 + 23 / 24,)], "t double")
    raw = [str(r[0]) for r in df.select(daynum_to_timestamp("t")).collect()]
    assert raw == ["1970-01-01 00:00:00", "1950-01-01 23:00:00.000003"]
    rounded = [str(r[0]) for r in df.select(daynum_to_timestamp("t", to_seconds=True)).collect()]
    assert rounded[1] == "1950-01-01 23:00:00"


def test_melt_keeps_cells_with_their_station(spark):
    wide = spark.createDataFrame([(719529.0, 1.0, 10.0), (719530.0, NAN, 20.0)], "t double, a double, b double")
    about = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "station_name string, latitude double, longitude double")
    got = melt_matrix(wide, about).orderBy("station_name", "time").collect()
    assert [(r.station_name, r.sea_level, r.latitude) for r in got] == [
        ("a", 1.0, 1.0), ("a", None, 1.0), ("b", 10.0, 3.0), ("b", 20.0, 3.0)]


def test_prepare_dataset(spark, tmp_path):
    wide = spark.range(30).select(
        (F.col("id") + 719529.0).alias("t"), F.lit(1.0).alias("a"), F.lit(2.0).alias("b"), F.lit(3.0).alias("c")
    )
    made = prepare_dataset(wide, train=["a", "c"], test=["b"], cols=S.__class__(attrs=()))
    assert (made.train.count(), made.test.count(), made.index.count()) == (60, 30, 10)
    made.write(str(tmp_path / "d"), partition_by=["station_name"])
    assert read_readings(spark, str(tmp_path / "d" / "train"), S.__class__(attrs=())).count() == 60
    assert read_index(spark, str(tmp_path / "d" / "index")).count() == 10
