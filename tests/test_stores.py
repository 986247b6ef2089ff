"""Stored and maintained tables, bundles, counts on the way, and wide matrices."""

import math
import random
from concurrent.futures import ThreadPoolExecutor
from datetime import date

import oracle
import pytest
from fixtures import S, days, reading, readings
from pyspark.sql import functions as F

from gauge_engine.catalog import ORACLES, QUERIES
from gauge_engine.catalog.stand_ins import EVENTS, ORDERS, event_readings, order_readings
from gauge_engine.operators.daily import daily_rollup, daily_slim
from gauge_engine.operators.index import index_with_ids
from gauge_engine.operators.maintained import DailyStore
from gauge_engine.operators.metrics import CountedTables, scores_by_group
from gauge_engine.operators.models import BoostingSettings, ModelBundle, fingerprint, load_or_fit
from gauge_engine.operators.splits import keep_listed_entities
from gauge_engine.operators.thresholds import reading_thresholds
from gauge_engine.plans.forecast import forecast
from gauge_engine.plans.prepare import prepare_dataset, prepare_listed
from gauge_engine.plans.training import flagged_daily, training_windows, training_windows_segmented, windows_of
from gauge_engine.sources.matrix import melt_matrix
from gauge_engine.sources.sinks import store_bucketed, store_by_entity

SF = "/root/testdata/sf0.001"
QUICK = BoostingSettings(rounds=2, rate=0.3, depth=2)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def waves(spark):
    rows = [reading(s, d, math.sin(i / 9 + k) * 3 + (i * (k + 3)) % 5 / 5) for k, s in enumerate("abc") for i, d in enumerate(days(60))]
    return readings(spark, rows).cache()


# --- entity folders and buckets -------------------------------------------------------------------


def test_a_listing_prunes_folders_at_run_time(spark, tmp_path):
    stored = store_by_entity(event_readings(spark, SF), str(tmp_path / "events"), EVENTS)
    names = spark.createDataFrame([("click",), ("click",), ("absent",), (None,)], "event_type string")
    listing = str(tmp_path / "names")
    names.write.parquet(listing)
    kept = keep_listed_entities(stored, spark.read.parquet(listing), EVENTS)
    rows = sorted(tuple(r) for r in kept.select("event_id", "event_type", "ts").collect())
    assert rows == sorted(tuple(r) for r in event_readings(spark, SF).where("event_type = 'click'").select("event_id", "event_type", "ts").collect())
    assert "dynamicpruning" in plan(kept)


def test_prepared_from_listed_entities(spark):
    names = [f"s{k}" for k in range(6)]
    wide = spark.range(24 * 40).select((F.col("id") / 24 + 719529.0).alias("t"), *[(F.col("id") % (k + 2)).cast("double").alias(n) for k, n in enumerate(names)])
    about = spark.createDataFrame([(n, 1.0 * k, 2.0) for k, n in enumerate(names)], "station_name string, latitude double, longitude double")

    def listed(*n):
        return spark.createDataFrame([(x,) for x in n], "station_name string")

    one = prepare_listed(wide, listed("s0", "s1", "s1", "none"), listed("s2"), about, S)
    two = prepare_dataset(wide, about, ["s0", "s1"], ["s2"], S)
    for a, b in ((one.train, two.train), (one.test, two.test), (one.index, two.index)):
        assert a.columns == b.columns and sorted(a.collect()) == sorted(b.collect()) and a.count() > 0
    none = prepare_listed(wide, listed(), listed("s2"), about, S)
    assert none.train.count() == 0


def test_windows_over_sorted_buckets_need_no_exchange_and_no_sort(spark):
    flagged = flagged_daily(order_readings(spark, SF), ORDERS)
    stored = store_bucketed(flagged, "flagged_days_test", ORDERS.entity, ORDERS.date, buckets=4)
    windows = windows_of(stored, ORDERS)
    text = plan(windows)
    assert "Exchange" not in text and "Sort [" not in text and "Bucketed: true" in text
    want = windows_of(flagged, ORDERS)
    key = ["o_orderpriority", "hist_start"]
    assert windows.orderBy(*key).collect() == want.orderBy(*key).collect()
    assert sorted(map(str, stored.collect())) == sorted(map(str, flagged.collect()))


# --- maintained series ----------------------------------------------------------------------------


def store_rows(df):
    return {(r.station_name, r.date): (pytest.approx(r.sea_level), r.sea_level_max, r.reading_count, pytest.approx(r.reading_squares, abs=1e-6)) for r in df.collect()}


def test_batches_give_what_one_rollup_gives(spark, tmp_path):
    draw = random.Random(3)
    rows = [reading(s, d, draw.choice([None, float("nan"), draw.gauss(1e6, 2)]), h) for s in "ab" for d in days(12) for h in range(6)]
    rows += [reading("c", days(12)[3], None)]
    draw.shuffle(rows)
    store = DailyStore(spark, str(tmp_path / "store"))
    assert store.daily().collect() == []
    for batch, at in enumerate(range(0, len(rows), 40)):
        store.refresh(readings(spark, rows[at : at + 40]), batch)
        if batch == 1:
            store.refresh(readings(spark, rows[at : at + 40]), batch)  # repeated after a failure
    whole = daily_rollup(readings(spark, rows), S, attrs=(), moments=True)
    got, want = store_rows(store.daily()), store_rows(whole)
    assert set(got) == set(want)
    for key, row in {(r.station_name, r.date): r for r in store.daily().collect()}.items():
        assert (row.sea_level, row.sea_level_max, row.reading_count) == want[key][:3]
        assert (row.reading_squares or 0.0) == pytest.approx({(r.station_name, r.date): r.reading_squares or 0.0 for r in whole.collect()}[key], abs=1e-5)
    limits = {r.station_name: r.flood_threshold for r in store.thresholds().collect()}
    for r in reading_thresholds(whole, S).collect():
        assert limits[r.station_name] == (pytest.approx(r.flood_threshold) if r.flood_threshold is not None else None)


def test_a_batch_reads_and_rewrites_only_its_days(spark, tmp_path):
    path = tmp_path / "store"
    store = DailyStore(spark, str(path))
    store.refresh(readings(spark, [reading("a", d, 1.0) for d in days(10)]), 0)
    before = {p: p.stat().st_mtime_ns for p in path.glob("date=*/*.parquet")}
    late = readings(spark, [reading("a", days(10)[2], 5.0), reading("b", date(2021, 5, 1), 1.0)])
    rolled = daily_rollup(late, S, attrs=(), moments=True)
    assert "dynamicpruning" in plan(store.touched(rolled))
    store.refresh(late, 1)
    after = {p: p.stat().st_mtime_ns for p in path.glob("date=*/*.parquet")}
    kept = set(before) & set(after)
    assert len(kept) == 9 and all(before[p] == after[p] for p in kept)
    rows = {(r.station_name, r.date): r.sea_level for r in store.daily().collect()}
    assert rows[("a", days(10)[2])] == 3.0 and rows[("b", date(2021, 5, 1))] == 1.0 and len(rows) == 11


# --- bundles --------------------------------------------------------------------------------------


def test_fingerprints_ignore_order_only(spark):
    rows = [(k % 5, float(k)) for k in range(50)]
    df = spark.createDataFrame(rows, "a int, b double")
    mark = fingerprint(df, "a", "b")
    assert mark == fingerprint(df.orderBy(F.desc("b")).repartition(3), "a", "b")
    for other in (rows[1:], rows + rows[:1], [(r[0], r[1] + 1) for r in rows], rows[:-2] + [(4, 48.0), (3, 49.0)]):
        assert fingerprint(spark.createDataFrame(other, "a int, b double"), "a", "b") != mark
    assert fingerprint(df.limit(0), "a", "b") == fingerprint(df.where("a > 9"), "a", "b") != mark


def test_bundles_of_other_readings_or_other_choices_are_refused(spark, waves, tmp_path):
    path, index = str(tmp_path / "m"), index_with_ids(daily_slim(waves, S), S)
    train = waves.where("station_name <> 'c'")

    def again(rows=train, **kw):
        return forecast(rows, waves, index, S, settings=QUICK, stds=0.5, bundle_path=path, **kw)

    first = sorted(again().collect())
    assert sorted(again().collect()) == first
    with pytest.raises(ValueError, match="has trained_on"):
        again(waves)
    for other in ({"refit": True}, {"refit": True, "split": "tail"}, {"refit": True, "patience": 3}):
        with pytest.raises(ValueError, match="has validation"):
            again(**other)
    assert sorted(again().collect()) == first


@pytest.mark.parametrize("choice", [{"split": "tail"}, {"split": "random", "metric": "Logloss"}, {"patience": 1}])
def test_every_way_of_choosing_rounds_is_remembered(spark, waves, tmp_path, choice):
    path, index = str(tmp_path / "m"), index_with_ids(daily_slim(waves, S), S)
    one = forecast(waves, waves, index, S, settings=QUICK, stds=0.5, bundle_path=path, refit=True, **choice)
    two = forecast(waves, waves, index, S, settings=QUICK, stds=0.5, bundle_path=path, refit=True, **choice)
    assert sorted(one.collect()) == sorted(two.collect())
    with pytest.raises(ValueError, match="has validation"):
        forecast(waves, waves, index, S, settings=QUICK, stds=0.5, bundle_path=path, refit=True)


def test_two_fits_at_once_leave_one_whole_bundle(spark, tmp_path):
    path = str(tmp_path / "b")

    def bundle(k):
        table = spark.createDataFrame([(f"s{k}", float(k))], "station_name string, flood_threshold double")
        return ModelBundle(None, [f"f{k}"], kind="scorer", thresholds=table, scaler=table.withColumn("k", F.lit(k)))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: bundle(k).save(spark, path), range(4)))
    found = ModelBundle.load(spark, path)
    k = int(found.features[0][1:])
    assert found.thresholds.first().station_name == f"s{k}" and found.scaler.first().k == k
    assert load_or_fit(spark, path, lambda: pytest.fail("fitted again")).features == found.features


def test_unpublished_attempts_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "b")
    assert ModelBundle.load(spark, path) is None
    spark.range(1).write.parquet(f"{path}/attempts/x/scaler")
    assert ModelBundle.load(spark, path) is None
    (tmp_path / "b" / "published").mkdir()
    assert ModelBundle.load(spark, path) is None


# --- counts on the way, group scores --------------------------------------------------------------


def test_tables_are_counted_by_the_plan_that_runs(spark):
    tables = CountedTables()
    rows = tables.counted("rows", spark.range(100), even=F.col("id") % 2 == 0, none=F.col("id") < 0)
    groups = tables.counted("groups", rows.groupBy((F.col("id") % 7).alias("g")).count())
    assert groups.collect() and {r.table: r.rows for r in tables.summary(spark).collect()} == {"rows": 100, "even": 50, "none": 0, "groups": 7}
    with pytest.raises(ValueError, match="twice"):
        tables.counted("rows", rows)


def test_the_summary_scans_once(spark):
    tables = CountedTables()
    slim = tables.counted("days", daily_slim(tables.counted("readings", event_readings(spark, SF)), EVENTS))
    assert plan(tables.counted("entities", slim.select("event_type").distinct())).count("FileScan") == 1


def test_scores_of_no_rows_have_a_total(spark):
    none = spark.createDataFrame([], "g int, y int, p double")
    row = scores_by_group(none, "g", "p", "y").collect()
    assert [(r.g, r.tn, r.fp, r.fn, r.tp, r.acc, r.f1, r.mcc) for r in row] == [(None, 0, 0, 0, 0, None, 0.0, 0.0)]
    some = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.1), (3, 1, 0.2)], "g int, y int, p double")
    assert sorted((r.g or 0, r.tn, r.fn, r.tp) for r in scores_by_group(some, "g", "p", "y").collect()) == [(0, 1, 0, 1), (0, 1, 1, 1), (3, 0, 1, 0)]


# --- segments -------------------------------------------------------------------------------------


@pytest.mark.parametrize("kw", [{"drop_last": True}, {"guard_nulls": False}, {"drop_last": True, "guard_nulls": False, "layout": "matrix"}])
def test_segmented_windows_take_every_choice(spark, waves, kw):
    holed = waves.withColumn("sea_level", F.when(F.dayofmonth("time") != 7, F.col("sea_level")))
    table = spark.createDataFrame([("a", 0.1), ("b", 2.0)], "station_name string, flood_threshold double")
    key = ["station_name", "hist_start"]
    want = training_windows(holed, S, table=table, **kw).orderBy(*key).collect()
    got = training_windows_segmented(holed, S, table=table, segment_rows=25, **kw).orderBy(*key).collect()
    assert got == want and len(want) > 10


# --- wide matrices --------------------------------------------------------------------------------


def test_a_wide_matrix_has_the_plan_of_a_narrow_one(spark):
    def melted(columns):
        names = [f"s.{k}`" for k in range(columns)]
        wide = spark.createDataFrame([(719529.0, *[float(k) for k in range(columns)]), (719530.0, *[None] * columns)], ", ".join(["t double", *[f"`{n.replace('`', '``')}` double" for n in names]]))
        about = spark.createDataFrame([(names[1], 1.0, 2.0), ("other", 3.0, 4.0)], "station_name string, latitude double, longitude double")
        return melt_matrix(wide, about, S)

    narrow, broad = melted(5), melted(5000)
    nodes = [len([x for x in plan(df).splitlines() if x.strip()]) for df in (narrow, broad)]
    assert nodes[0] == nodes[1]
    found = {(r.time.day, r.station_name): (r.latitude, r.sea_level) for r in broad.collect()}
    assert len(found) == 10_000 and found[(1, "s.4321`")] == (None, 4321.0) and found[(1, "s.1`")] == (1.0, 1.0) and found[(2, "s.7`")] == (None, None)


NAMES = ["daily_refreshed", "run_summary", "melt_matrix", "prepare_dataset", "prepare_listed", "windows_bucketed", "windows_segmented_given",
         "scoring_windows_segmented", "training_windows_segmented", "semi_entities", "scores_by_window"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_match_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert oracle.differences(QUERIES[name](spark, sf), oracle.connect(sf), ORACLES[name]) == []
