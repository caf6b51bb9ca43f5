"""Pipelines over the order tables, one per session, folder and set of windows."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cohortspark.config import Windows
from cohortspark.plans.pipeline import Pipeline
from cohortspark.sources import starschema

_OPEN: dict[tuple, Pipeline] = {}


def order_pipeline(spark: SparkSession, folder: str, windows: Windows = starschema.LATE) -> Pipeline:
    key = (spark.sparkContext.applicationId, "orders", folder, windows)
    if key not in _OPEN:
        _OPEN[key] = Pipeline(spark, f"orders:{folder}", windows, source=lambda: starschema.invoice_lines(spark, folder))
    return _OPEN[key]


def event_pipeline(spark: SparkSession, folder: str, windows: Windows = starschema.EVENT_MONTH) -> Pipeline:
    key = (spark.sparkContext.applicationId, "events", folder, windows)
    if key not in _OPEN:
        _OPEN[key] = Pipeline(
            spark, f"events:{folder}", windows, qualified_source=lambda: starschema.purchase_events(spark, folder)
        )
    return _OPEN[key]
