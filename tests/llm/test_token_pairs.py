"""Pairs of a token join are made once."""

from gauge_engine.llm.ngram_join import _met_once


def test_a_pair_is_made_at_its_first_common_token_only(spark):
    """Twelve sets of a family share most of the ten tokens of their prefixes."""
    rows = []
    for k in range(12):
        prefix = [100 + t for t in range(10) if t % 6 != k % 6] + [1000 + k]
        rows += [(t, k, k, 100, i, i, [0, 0, 0, 0], prefix) for i, t in enumerate(prefix)]
    schema = "token long, set_key long, component long, n long, i int, pos int, bitmap array<long>, prefix array<long>"
    pairs = sorted((r.a, r.b) for r in _met_once(spark.createDataFrame(rows, schema), 90).collect())
    assert pairs == [(a, b) for a in range(12) for b in range(a + 1, 12)]
