"""Integrity and leakage checks. Data checks return one row of violation counts; `require` raises on any."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.config import FEATURE_COLUMNS, FUTURE_COLUMNS, LABEL, NON_PREDICTORS, PREDICTORS, TIERS, Windows
from cohortspark.functions.columns import between_days, up_to
from cohortspark.sources.tables import check_columns


def label_violations(table: DataFrame) -> DataFrame:
    """Missing labels, labels other than 0 and 1, and customers beyond their first row."""
    per_customer = table.groupBy("CustomerID").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(LABEL).isNull()).alias("missing"),
        F.count_if(~F.col(LABEL).isin(0, 1)).alias("other"),
    )
    return per_customer.agg(
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_labels"),
        F.coalesce(F.sum("other"), F.lit(0)).alias("non_binary_labels"),
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("repeated_customers"),
    )


def window_violations(observed: DataFrame, future: DataFrame, table: DataFrame, windows: Windows) -> DataFrame:
    """Lines outside their window, a snapshot day without lines, and negative recency."""
    seen = observed.agg(
        F.count_if(~up_to(windows.snapshot)).alias("late_observation_rows"),
        F.when(F.count_if(between_days(windows.snapshot, windows.snapshot)) > 0, 0).otherwise(1).alias("snapshot_day_missing"),
    )
    outside = future.agg(F.count_if(~between_days(windows.future_start, windows.future_end)).alias("n"))
    negative = table.agg(F.count_if(F.col("Recency") < 0).alias("n"))
    return seen.withColumn("future_rows_outside", outside.scalar()).withColumn("negative_recency", negative.scalar())


def split_overlap(split: DataFrame) -> DataFrame:
    """Customers found in both the training and the test rows."""
    both = split.groupBy("CustomerID").agg(F.countDistinct("is_test").alias("sides")).filter("sides > 1")
    return both.agg(F.count(F.lit(1)).alias("overlapping_customers"))


def population_counts(qualified: DataFrame, table: DataFrame, split_risk: DataFrame) -> DataFrame:
    """Sizes a study is known by: lines, eligible, classes, both sides of the split, tiers."""
    lines = qualified.agg(F.count(F.lit(1)))
    people = table.agg(
        F.count(F.lit(1)).alias("eligible_customers"),
        F.count_if(F.col(LABEL) == 1).alias("inactive"),
        F.count_if(F.col(LABEL) == 0).alias("active"),
    )
    sides = split_risk.agg(
        F.struct(
            F.count_if(~F.col("is_test")).alias("train_size"),
            F.count_if(F.col("is_test")).alias("test_size"),
            *[F.count_if(F.col("Risk_Tier") == t).alias(t.lower().replace(" ", "_")) for t in TIERS],
        )
    )
    return (
        people.withColumn("qualified_rows", lines.scalar()).withColumn("_sides", sides.scalar()).select("*", "_sides.*").drop("_sides")
    )


def require_counts(counts: DataFrame, expected: dict[str, int]) -> None:
    """Raise when any expected size differs."""
    found = counts.first().asDict()
    wrong = {k: (found.get(k), v) for k, v in expected.items() if found.get(k) != v}
    if wrong:
        raise ValueError(f"sizes differ (found, expected): {wrong}")


def require(violations: DataFrame) -> None:
    found = {k: v for k, v in violations.first().asDict().items() if v}
    if found:
        raise ValueError(f"integrity check failed: {found}")


def require_no_future_columns(columns: Iterable[str]) -> None:
    leaked = sorted(set(columns) & set(FUTURE_COLUMNS))
    if leaked:
        raise ValueError(f"columns about the label window: {leaked}")


def require_predictors(columns: Iterable[str] = PREDICTORS) -> None:
    leaked = sorted(set(columns) & set(NON_PREDICTORS))
    if leaked:
        raise ValueError(f"not allowed as predictors: {leaked}")


def require_feature_columns(table: DataFrame) -> DataFrame:
    return check_columns(table, FEATURE_COLUMNS)


def overlapping_columns(table: DataFrame, forbidden: Iterable[str] = FUTURE_COLUMNS) -> list[str]:
    return sorted(set(table.columns) & set(forbidden))
