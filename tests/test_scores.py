import json
import math

import pytest
from fixtures import brute_auc
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gauge_engine.operators.metrics import (
    class_balance,
    label_balance,
    roc_auc,
    score_column,
    score_histogram,
    scored_pairs,
    scores_by_group,
)
from gauge_engine.plans.evaluate import score_predictions
from gauge_engine.sources.sinks import score_json

PAIRS = "y_true int, score double"


def tables(spark, truth, probs):
    t = spark.createDataFrame(list(enumerate(truth)), "id bigint, y_true int")
    p = spark.createDataFrame(list(enumerate(probs)), "id bigint, y_prob double")
    return t, p


def auc(spark, truth, scores, bits=9):
    df = spark.createDataFrame(list(zip(truth, scores)), PAIRS)
    return roc_auc(score_histogram(df), bits).first().auc


def test_published_case(spark):
    """21 rows, one negative (id 13) outranked by 9 of 20 positives, nothing above 0.5."""
    truth = [0 if i == 13 else 1 for i in range(21)]
    probs = [0.25] * 21
    positives = [i for i in range(21) if i != 13]
    for i in positives[:9]:
        probs[i] = 0.4
    for i in positives[9:]:
        probs[i] = 0.1
    got = score_predictions(*tables(spark, truth, probs)).first()
    assert got.auc == pytest.approx(0.45)
    assert got.acc == pytest.approx(0.047619047619047616)
    assert (got.f1, got.mcc, got.n) == (0.0, 0.0, 21)


@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.1, 0.5, 0.5000001, 0.9, 1.0])), min_size=1, max_size=60))
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_auc_against_all_pairs(spark, rows):
    truth, scores = [r[0] for r in rows], [r[1] for r in rows]
    want = brute_auc(truth, scores)
    for bits in (1, 9):
        assert auc(spark, truth, scores, bits) == pytest.approx(want)


def test_auc_properties(spark):
    truth = [i * i % 7 % 2 for i in range(200)]
    scores = [((i * 31) % 53) / 53 for i in range(200)]
    base = auc(spark, truth, scores)
    assert base == pytest.approx(brute_auc(truth, scores))
    assert auc(spark, truth, [math.exp(3 * s) for s in scores]) == pytest.approx(base)
    assert auc(spark, truth, [-s for s in scores]) == pytest.approx(1 - base)
    assert auc(spark, truth, [1.0] * 200) == pytest.approx(0.5)


def test_single_class_and_missing_score_give_half(spark):
    assert auc(spark, [1, 1], [0.1, 0.9]) == 0.5
    assert auc(spark, [1, 0], [float("nan"), 0.9]) == 0.5
    got = score_predictions(*tables(spark, [1, 0], [float("nan"), 0.9])).first()
    # A missing score decides 0.
    assert (got.auc, got.acc, got.n) == (0.5, 0.0, 2)


def test_all_right_and_all_wrong(spark):
    right = score_predictions(*tables(spark, [0, 0, 1, 1], [0.1, 0.2, 0.5, 0.9])).first()
    assert (right.auc, right.acc, right.f1, right.mcc) == pytest.approx((1, 1, 1, 1))
    wrong = score_predictions(*tables(spark, [1, 1, 0, 0], [0.1, 0.2, 0.5, 0.9])).first()
    assert (wrong.auc, wrong.acc, wrong.f1, wrong.mcc) == pytest.approx((0, 0, 0, -1))


def test_no_overlap_fails(spark):
    t, p = tables(spark, [1, 0], [0.1, 0.2])
    with pytest.raises(Exception, match="no overlapping ids"):
        score_predictions(t, p.selectExpr("id + 100 AS id", "y_prob")).collect()


@pytest.mark.parametrize("row", [(None, 1), (2, None)])
def test_unusable_truth_fails(spark, row):
    t = spark.createDataFrame([(0, 1), (1, 0), row], "id bigint, y_true int")
    p = spark.createDataFrame([(0, 0.9), (1, 0.2), (2, 0.2)], "id bigint, y_prob double")
    with pytest.raises(Exception, match="without a usable"):
        score_predictions(t, p).collect()
    assert score_predictions(t.dropna(), p).first().n == 2


def test_repeated_ids_count_every_pair(spark):
    t = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0)], "id bigint, y_true int")
    p = spark.createDataFrame([(1, 0.9), (1, 0.2), (2, 0.4)], "id bigint, y_prob double")
    got = score_predictions(t, p).first()
    joined = [(1, 0.9), (1, 0.9), (0, 0.9), (1, 0.2), (1, 0.2), (0, 0.2), (0, 0.4)]
    assert got.n == 7
    assert got.auc == pytest.approx(brute_auc([a for a, _ in joined], [b for _, b in joined]))


def test_one_hot_id_is_counted_not_multiplied(spark):
    t = spark.range(3000).selectExpr("CASE WHEN id < 2000 THEN 0 ELSE id END AS id", "CAST(id % 2 AS INT) AS y_true")
    p = spark.range(3000).selectExpr("CASE WHEN id < 2000 THEN 0 ELSE id END AS id", "0.7D AS y_prob")
    pairs = scored_pairs(t, p)
    # Each prediction meets at most one row per class.
    assert pairs.count() == 2 * 2000 + 1000
    assert pairs.agg({"weight": "sum"}).first()[0] == 2000 * 2000 + 1000


def test_score_column_fallback(spark):
    assert score_column(["id", "label", "y_prob"]) == "y_prob"
    assert score_column(["id", "label", "other"]) == "label"
    assert score_column(["id", "first", "second"]) == "second"
    t = spark.createDataFrame([(0, 1), (1, 0)], "id bigint, y_true int")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "id bigint, label int")
    others = spark.createDataFrame([(0, 1.0), (1, 0.0)], "id bigint, anything double")
    assert score_predictions(t, labels).first().acc == 1.0
    assert score_predictions(t, others).first().acc == 1.0


def test_groups_and_overall(spark):
    rows = [(0, 1, 0.9), (0, 0, 0.5), (1, 1, 0.2), (1, 0, 0.1)]
    df = spark.createDataFrame(rows, "g int, y int, p double")
    got = {r.g: r for r in scores_by_group(df, "g", "p", "y").collect()}
    assert got[0].acc == 1.0 and got[1].acc == 0.5 and got[1].f1 == 0.0
    assert (got[None].tn, got[None].fp, got[None].fn, got[None].tp) == (2, 0, 1, 1)


def test_balance(spark):
    df = spark.createDataFrame([(1, [1, 0]), (0, [0, 0]), (0, [0, 0])], "y int, y_days array<int>")
    got = class_balance(df).first()
    assert (got.pos, got.neg, got.weight) == (1, 2, 2.0)
    cells = label_balance(df).first()
    assert (cells.pos, cells.neg, cells.weight) == (1, 5, 5.0)
    none = class_balance(df.filter("y = 0")).first()
    assert (none.pos, none.neg, none.weight) == (0, 2, 2.0)


def test_score_json(spark):
    text = score_json(score_predictions(*tables(spark, [0, 1], [0.1, 0.9]))).first().json
    assert json.loads(text) == {"auc": 1.0, "acc": 1.0, "f1": 1.0, "mcc": 1.0, "n": 2}
