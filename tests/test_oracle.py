"""Every query against its SQL counterpart on the given tables."""

from pathlib import Path

import oracle
import pytest

from gauge_engine.catalog import ORACLES, QUERIES

DATA = Path("/root/testdata")
# On the smallest tables no entity has seven consecutive days of orders.
NEEDS_MORE_DATA = {"interval_hist", "interval_truth", "interval_eval"}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def connections():
    return {sf: oracle.connect(str(DATA / sf)) for sf in ("sf0.001", "sf0.01")}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, connections, name):
    sf = "sf0.01" if name in NEEDS_MORE_DATA else "sf0.001"
    df = QUERIES[name](spark, str(DATA / sf))
    assert oracle.differences(df, connections[sf], ORACLES[name]) == []


def test_counts_on_the_given_tables(spark):
    sf = str(DATA / "sf0.01")
    assert QUERIES["window_anchors"](spark, sf).count() == 8523
    assert QUERIES["index_calendar"](spark, sf).count() == 8556


def test_entry_has_fifty_windows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
