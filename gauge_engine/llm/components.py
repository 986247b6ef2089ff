"""Connected components by alternating stars, every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gauge_engine.session import materialize


def materialize_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """A written table and its number of rows, from the one job that writes it."""
    seen = Observation()
    written = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return written, seen.get["n"]


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """A written edge table, and its size and a checksum of its edges."""
    seen = Observation()
    checksum = F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 31)), F.lit(0))
    written = materialize(edges.observe(seen, F.count("u").alias("n"), checksum.alias("sum")), "edges")
    return written, (seen.get["n"], seen.get["sum"])


# Up to so many edges, 16 bytes each, a round runs in one task and needs no exchange; beyond
# it, rounds are shuffled. The steps and the result are the same.
ONE_TASK_EDGES = 500_000


def _together(edges: DataFrame, small: bool) -> DataFrame:
    return edges.coalesce(1) if small else edges


def _oriented(edges: DataFrame) -> DataFrame:
    """``u > v``, each edge once, no loops."""
    return (
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    """Every larger neighbour of a node is joined to the smallest node around it."""
    both = _together(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), small)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    """A node and its smaller neighbours are joined to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _together(others.union(least.select("u", F.col("m").alias("v"))), small)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the smallest node of each component, for nodes with an edge.

    A node of a component of one has no row. The number of rounds grows with the logarithm
    of the longest path; a hub's edges meet only in joins, which adaptive execution splits.
    """
    now, state = _written(_oriented(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    seen = None
    while True:
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = state
        small = state[0] <= ONE_TASK_EDGES
        now, state = _written(_oriented(_small_star(_oriented(_large_star(_together(now, small), small)), small)))
