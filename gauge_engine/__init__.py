"""Threshold-event forecasting over sensor time series, expressed as Spark jobs."""

from gauge_engine.columns import SensorColumns

__all__ = ["SensorColumns"]
