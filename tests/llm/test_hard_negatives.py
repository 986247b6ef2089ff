"""Hard negatives against every pair scored one by one."""

import math
import random
from pathlib import Path

import numpy as np
import oracle
import pandas as pd
import pytest

from gauge_engine.llm import hard_negatives as hn
from gauge_engine.llm.catalog import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.01")
SCHEMA = "vec_id bigint, label int, embedding array<float>, score string, rank int"


def brute(rows, low=80):
    taken = {
        (i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        for i, lab, v in rows
        if lab is not None and v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)
    }

    def ranked(scored):
        return sorted(set(scored), key=lambda s: (-s[1], s[0] is None, s[0] or 0))[:5]

    out = set()
    for a, label, v in taken:
        if a is None or a % 100:
            continue
        scores = [(i, sum(x * y for x, y in zip(v, w)), lab == label) for i, lab, w in taken]
        for p, ps in ranked((i, s) for i, s, same in scored_as(scores, True) if i != a):
            fits = [(i, s) for i, s, same in scored_as(scores, False) if low * ps <= 100 * s <= 100 * ps]
            out |= {(a, p, k + 1, n, ps, s) for k, (n, s) in enumerate(ranked(fits))}
    return out


def scored_as(scores, same):
    return [s for s in scores if s[2] == same]


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    got = hn.hard_negatives(df, "id % 100 = 0", **kw).collect()
    return [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 16)
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 16))
    rows = []
    for i in range(900):
        v = centres[draw.integers(12)] + draw.choice([0.05, 0.6]) * draw.normal(size=16)
        rows.append((i, int(draw.integers(4)), (v * draw.choice([0.2, 1, 3])).tolist()))
    rows += [(2000 + k, 1, rows[100][2]) for k in range(30)] + [(3000 + k, 2, rows[100][2]) for k in range(30)]  # ties
    rows += [rows[100], rows[100], rows[7]]  # repeated rows
    rows += [
        (4000, None, [1.0] * 16), (4100, 1, None), (4200, 1, [math.nan] + [1.0] * 15), (4300, 1, [None] + [1.0] * 15),
        (4400, 2, [math.inf] * 16), (4500, 3, [0.0] * 16), (4600, 3, []), (4700, 1, [0.5, 0.25]), (None, 1, rows[100][2]), (None, 2, rows[100][2]),
        (-5000, 0, [-0.3] * 16),
    ]
    got = found(spark, rows)
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)
    assert len(got) > 50


def test_large_components_stay_exact(spark):
    draw = random.Random(2)
    for top in (30.0, 3e5, 1e6):
        rows = [(i, i % 3, [draw.uniform(0.5, 1) * top for _ in range(8)]) for i in range(0, 300, 10)]
        assert set(found(spark, rows)) == brute(rows)


def test_too_long_vectors_fail(spark):
    with pytest.raises(Exception, match="may not fit in 64 bits"):
        found(spark, [(0, 1, [1e30]), (1, 1, [1.0])])


def test_empty_and_lonely(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, 1, [1.0])]) == []
    assert found(spark, [(0, 1, [1.0]), (1, 2, [1.0])]) == []
    assert found(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])]) == [(0, 1, 1, 2, 65536, 256 * 230)]
    assert found(spark, [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.9])]) == []  # a negative positive allows none


def test_bounds_hold_and_leave_blocks_out():
    draw = np.random.default_rng(8)
    centres = 200 * draw.normal(size=(6, 24)) / 5
    rows = np.floor(centres[draw.integers(6, size=3000)] + draw.normal(size=(3000, 24))).astype("i8")
    references = hn.farthest_first(rows[:500], 8)
    angles, norms = hn.angles_to(references, rows), np.linalg.norm(rows, axis=1)
    order = np.lexsort((angles.min(axis=1), angles.argmin(axis=1)))
    parts = [order[k : k + 100] for k in range(0, 3000, 100)]
    blocks = pd.DataFrame({
        "angles_from": [angles[p].min(axis=0) for p in parts], "angles_to": [angles[p].max(axis=0) for p in parts],
        "norm_from": [norms[p].min() for p in parts], "norm_to": [norms[p].max() for p in parts],
        "ids": [p.astype("<i8").tobytes() for p in parts], "labels": [np.zeros(len(p), "<i8").tobytes() for p in parts],
        "vectors": [rows[p].astype("<i2").tobytes() for p in parts], "width": 2, "dims": 24,
    })
    least, most = hn.score_bounds(angles[:40], norms[:40], blocks)
    for b, p in enumerate(parts):
        scores = rows[:40] @ rows[p].T
        assert (scores.min(axis=1) >= least[:, b]).all() and (scores.max(axis=1) <= most[:, b]).all()
    anchors = pd.DataFrame({"anchor_id": np.arange(40), "label": 0, "norm": norms[:40], "angles": list(angles[:40])})
    targets = hn.Targets(np.arange(40), np.full(40, hn.NO_SCORE + 1), np.full(40, hn.NO_ID - 1), 5, True)
    scored = hn.scan(anchors, rows[:40], blocks, targets)
    assert scored < 0.5 * 40 * len(parts)
    for a in range(40):
        every = sorted(((-int(rows[a] @ rows[i]), i) for i in range(3000) if i != a))[:5]
        assert [(-s, i) for s, i in zip(targets.scores[a], targets.ids[a])] == every


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_matches_sql(spark):
    con = oracle.connect(str(DATA))
    assert oracle.differences(QUERIES["op11_hard_negatives"](spark, str(DATA)), con, ORACLES["op11_hard_negatives"]) == []
