"""Order buckets of any number, radix selection and interval pieces."""

import random
from collections import Counter
from datetime import date, datetime, timedelta

import oracle
import pytest
from pyspark.sql import functions as F

from gauge_engine.catalog import ORACLES, QUERIES
from gauge_engine.operators import ordering
from gauge_engine.operators.intervals import day_number, interval_pieces, join_intervals, readings_in_intervals
from gauge_engine.operators.metrics import roc_auc, score_histogram
from gauge_engine.operators.ordering import with_earlier_buckets, with_order_buckets, with_positional_id
from gauge_engine.operators.splits import _hash_order, cutoff_hashes, split_random, split_stratified

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("buckets", [2, 512, 5000])
def test_positional_ids_and_auc_in_any_number_of_buckets(spark, buckets):
    df = spark.range(3000).select((F.col("id") * 37 % 3000).alias("v"), F.lit("x").alias("w")).repartition(7)
    got = with_positional_id(df, ["w", "v"], buckets=buckets).collect()
    assert len(got) == 3000 and all(r.id == r.v for r in got)
    pairs = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr(
        "CAST(l_returnflag = 'R' AS INT) AS y_true", "l_extendedprice * (1 - l_discount) AS score"
    )
    histogram = score_histogram(pairs)
    assert roc_auc(histogram, buckets).first().auc == pytest.approx(roc_auc(histogram).first().auc, abs=1e-12)


def test_buckets_follow_the_rows(spark):
    def spread(n):
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("v"))
        counts = with_order_buckets(df, "v", rows_per_bucket=1000).groupBy("_bucket").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        return sorted(tuple(r) for r in counts.collect())

    small, large = spread(4000), spread(64_000)
    assert len(small) == 4 and len(large) == 64
    for found in (small, large):
        assert all(a[3] < b[2] for a, b in zip(found, found[1:]))  # order is kept
        assert max(r[1] for r in found) < 2500
    assert spread(0) == [] and len(spread(1)) == 1


def test_the_input_of_order_buckets_is_shuffled_once(spark):
    rows = spark.read.parquet(f"{SF}/orders.parquet").groupBy("o_totalprice").agg(F.count("*").alias("n"))
    df = with_order_buckets(rows, "o_totalprice", rows_per_bucket=500)
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in text and "Filter (cast(pmod" not in text


def test_bucket_totals_are_summed_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK_BUCKETS", 4)
    draw = random.Random(1)
    rows = [(b, draw.randint(0, 9), float(b)) for b in draw.sample(range(100), 37)]
    got = with_earlier_buckets(spark.createDataFrame(rows, "_bucket int, v bigint, kept double"), "v", "before").collect()
    assert {(r._bucket, r.v, r.kept, r.before) for r in got} == {(b, v, k, sum(w for c, w, _ in rows if c < b)) for b, v, k in rows}


def test_bucket_numbers_are_checked(spark):
    for wrong in (0, 1 << 17):
        with pytest.raises(ValueError, match="buckets must lie"):
            with_order_buckets(spark.range(3), "id", buckets=wrong)


# --- radix selection ------------------------------------------------------------------------------


def slim(df, stratum):
    return df.select(stratum.alias("_stratum"), _hash_order(["id"], 42).alias("_hash"))


@pytest.mark.parametrize(("digits", "most", "rounds"), [(1, 40, 2), (1, 5, 3), (4, 0, 8), (4, 1 << 20, 1), (3, 0, 11)])
def test_every_way_of_narrowing_finds_the_same_hash(spark, digits, most, rounds):
    df = spark.range(3000)
    stratum = F.col("id") % 5 == 0
    hashes = {True: [], False: []}
    for row in slim(df, stratum).collect():
        hashes[row._stratum].append(row._hash)
    found = cutoff_hashes(slim(df, stratum), 0.2, "ceil", digits, most)
    for value, own in hashes.items():
        want = sorted(own)[-(-len(own) // 5) - 1]
        assert found[value].hash == want
    # The smaller stratum may need fewer.
    assert max(c.rounds for c in found.values()) == rounds


def test_splits_with_hot_null_and_empty_strata(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 990, 1).when(F.col("id") < 995, 0).alias("y"))
    marked = split_stratified(df, ["id"])
    counts = Counter((r.y, r.is_validation) for r in marked.collect())
    assert counts == {(1, True): 198, (1, False): 792, (0, True): 1, (0, False): 4, (None, False): 5}
    assert split_stratified(df.limit(0), ["id"]).collect() == []
    assert split_random(df, ["id"], share=0.0005).where("is_validation").count() == 0
    text = marked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text and "FileScan" not in text


# --- interval pieces ------------------------------------------------------------------------------


def test_a_century_makes_few_pieces(spark):
    rows = [(0, date(1925, 3, 7), date(2025, 11, 30)), (1, date(2000, 1, 1), date(2000, 1, 1)), (2, date(2001, 1, 2), date(2001, 1, 1)), (3, None, date(2000, 1, 1))]
    df = spark.createDataFrame(rows, "window_idx int, start_date date, end_date date")
    pieces = interval_pieces(df, day_number("start_date"), day_number("end_date")).collect()
    counts = Counter(r.window_idx for r in pieces)
    assert counts[0] < 40 and counts[1] == 1 and counts[2] == counts[3] == 0
    days = [d for r in pieces if r.window_idx == 0 for d in range(r._piece << r._level, (r._piece + 1) << r._level)]
    first = (date(1925, 3, 7) - date(1970, 1, 1)).days
    assert sorted(days) == list(range(first, first + (date(2025, 11, 30) - date(1925, 3, 7)).days + 1))


def test_pairs_against_comparing_all(spark):
    draw = random.Random(11)
    points = [(k, draw.randint(-300, 300)) for k in range(200)] + [(900, None)]
    intervals = [(k, a, a + draw.choice([-5, 0, 1, 6, 100, 500])) for k, a in enumerate(draw.randint(-300, 300) for _ in range(60))]
    found = join_intervals(
        spark.createDataFrame(points, "p int, v bigint"), spark.createDataFrame(intervals, "i int, a bigint, b bigint"), F.col("v"), F.col("a"), F.col("b")
    )
    got = [(r.p, r.i) for r in found.select("p", "i").collect()]
    want = {(p, i) for p, v in points for i, a, b in intervals if v is not None and a <= v <= b}
    assert len(got) == len(set(got)) and set(got) == want
    none = spark.createDataFrame([], "i int, a bigint, b bigint")
    assert join_intervals(spark.createDataFrame(points, "p int, v bigint"), none, F.col("v"), F.col("a"), F.col("b")).collect() == []


def test_timestamps_against_comparing_all(spark):
    draw = random.Random(12)
    zero = datetime(1969, 12, 30)

    def moment():
        return zero + timedelta(microseconds=draw.randint(0, 5 * 86_400_000_000))

    readings = [(k, moment()) for k in range(150)] + [(900, None)]
    intervals = [(k, a, a + timedelta(seconds=draw.choice([-1, 0, 0.000001, 59, 3600, 90_000]))) for k, a in enumerate(moment() for _ in range(50))]
    intervals += [(90, readings[0][1], readings[1][1]), (91, readings[2][1], readings[2][1] + timedelta(hours=1))]
    found = readings_in_intervals(
        spark.createDataFrame(readings, "p int, t timestamp_ntz"), spark.createDataFrame(intervals, "i int, start_time timestamp_ntz, end_time timestamp_ntz"), "t"
    )
    got = sorted((r.p, r.i) for r in found.collect())
    assert got == sorted((p, i) for p, t in readings for i, a, b in intervals if t is not None and a <= t < b)


def test_intervals_join_without_a_row_per_day(spark):
    points = spark.range(100).select("id")
    intervals = spark.createDataFrame([(0, 0, 1 << 20)], "i int, a bigint, b bigint")
    df = join_intervals(points, intervals, F.col("id"), F.col("a"), F.col("b"))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert df.count() == 100 and interval_pieces(intervals, F.col("a"), F.col("b")).count() <= 2


@pytest.mark.parametrize("name", ["interval_readings", "interval_hist", "interval_truth", "interval_eval", "positional_id", "auc_bucketed", "split_stratified", "split_random"])
def test_queries_match_sql(spark, name):
    assert oracle.differences(QUERIES[name](spark, SF), oracle.connect(SF), ORACLES[name]) == []


def test_pairs_are_counted_like_they_are_listed(spark):
    draw = random.Random(13)
    zero = datetime(1969, 12, 30)

    def moment():
        return zero + timedelta(microseconds=draw.randint(0, 3 * 86_400_000_000))

    readings = [(draw.choice(["a", "b", None]), moment(), draw.choice([float(draw.randint(0, 9)), None])) for _ in range(400)]
    readings += [("a", None, 1.0), ("only", zero, float("nan")), *readings[:5]]
    lengths = [-1, 0, 0.000001, 0.000003, 59, 3600, 4096, 5400, 90_000, 400_000]
    intervals = [(draw.choice([k, 7, None]), a, a + timedelta(seconds=draw.choice(lengths))) for k, a in enumerate(moment() for _ in range(120))]
    intervals += [(300 + k, t, t + timedelta(seconds=length)) for k, (_, t, _) in enumerate(readings[:20]) for length in (0.000001, 0.000002, 7200)]
    intervals += [(400, readings[0][1], readings[1][1]), (401, readings[1][1], readings[0][1]), (402, None, zero), (403, zero, zero + timedelta(days=9))]
    want = {}
    for i, a, b in intervals:
        for k, t, v in readings:
            if a is not None and t is not None and a <= t < b:
                want.setdefault((i, k), []).append(v)
    for kind in ("timestamp_ntz", "timestamp"):
        points = spark.createDataFrame(readings, f"k string, t {kind}, v double")
        bounds = spark.createDataFrame(intervals, f"i int, start_time {kind}, end_time {kind}")
        found = readings_in_intervals(points, bounds, "t", by=["i", "k"], sums={"total": "v"}).collect()
        got = {(r.i, r.k): (r.n, r.total) for r in found}
        assert len(got) == len(found) and set(got) == set(want)
        for key, values in want.items():
            known = [v for v in values if v is not None]
            assert got[key][0] == len(values) and (got[key][1] == pytest.approx(sum(known), nan_ok=True) if known else got[key][1] is None)
        assert readings_in_intervals(points, bounds.limit(0), "t", by=["i", "k"]).collect() == []


def test_dense_readings_are_counted_without_their_pairs(spark):
    points = spark.range(20_000).selectExpr("id % 3 AS k", "timestamp_micros(id * 1000) AS t")
    bounds = points.selectExpr("t AS start_time", "t + INTERVAL 10 SECONDS AS end_time").withColumn("i", F.monotonically_increasing_id())
    df = readings_in_intervals(points, bounds, "t", by=["i", "k"])
    # 150 million pairs; no join makes more than a few rows per reading and interval.
    assert df.agg(F.sum("n")).first()[0] == 10_000 * 10_000 + sum(range(1, 10_001))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("_piece") == 0 and "NestedLoop" not in text and "Cartesian" not in text
