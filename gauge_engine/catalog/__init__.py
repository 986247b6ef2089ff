"""Every operator as a runnable query over the given tables, with its SQL counterpart."""

from gauge_engine.catalog import (  # noqa: F401
    horizon,
    learning,
    scoring,
    series,
    sources,
    windows,
)
from gauge_engine.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
