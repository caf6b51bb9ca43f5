"""One row per customer: behaviour up to the snapshot, country, scores and label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.config import FEATURE_COLUMNS, LABEL, PREDICTORS, Windows
from cohortspark.functions.columns import exact_sum, in_future, in_observation, midnight
from cohortspark.operators.cohort import is_eligible
from cohortspark.operators.scoring import add_rfm_scores


def main_country(lines: DataFrame) -> DataFrame:
    """Country with the most lines per customer; ties go to the later purchase, then to alphabetical order.

    Lines are first counted per customer and country, so even the busiest customer is a handful of rows when
    the choice is made.
    """
    counted = (
        lines.filter(F.col("CustomerID").isNotNull() & F.col("Country").isNotNull())
        .groupBy("CustomerID", "Country")
        .agg(F.count("InvoiceNo").alias("lines"), F.max("InvoiceDate").alias("last"))
    )
    order = F.struct(
        (-F.col("lines")).alias("fewer"),
        F.expr("timestamp_ntz'1970-01-01 00:00:00' - last").alias("earlier"),
        F.col("Country").alias("Country"),
    )
    return counted.groupBy("CustomerID").agg(F.min(order).getField("Country").alias("Country"))


def _summary(lines: DataFrame, seen: Column, *more: Column) -> DataFrame:
    """Per-customer aggregate of the lines where `seen` holds.

    The distinct counts run on (customer, value) keys first, so a customer with very many lines is spread out.
    """

    def when_seen(column) -> Column:
        return F.when(seen, F.col(column) if isinstance(column, str) else column)

    return lines.groupBy("CustomerID").agg(
        F.min(when_seen("InvoiceDate")).alias("first"),
        F.max(when_seen("InvoiceDate")).alias("last"),
        F.countDistinct(when_seen("InvoiceNo")).alias("invoices"),
        F.countDistinct(when_seen("StockCode")).alias("UniqueProducts"),
        F.countDistinct(when_seen(F.trunc("InvoiceDate", "MM"))).alias("ActiveMonths"),
        exact_sum(when_seen("Revenue")).alias("Monetary"),
        F.sum(when_seen("Quantity")).alias("TotalItems"),
        *more,
    )


def _as_features(summary: DataFrame, windows: Windows, *more: str) -> DataFrame:
    snapshot = midnight(windows.snapshot)
    shaped = summary.withColumns(
        {
            "Recency": F.datediff(snapshot, "last"),
            "Frequency": F.col("invoices"),
            "AvgOrderValue": F.try_divide(F.col("Monetary"), F.col("invoices").cast("double")),
            "TenureDays": F.datediff(snapshot, "first"),
            "PurchaseSpanDays": F.datediff("last", "first"),
        }
    )
    return shaped.select("CustomerID", *PREDICTORS, *more)


def behaviour(lines: DataFrame, windows: Windows) -> DataFrame:
    """The nine numbers for every customer with a line up to the snapshot."""
    observed = lines.filter(in_observation(windows) & F.col("CustomerID").isNotNull())
    return _as_features(_summary(observed, F.lit(True)), windows)


def customer_features(lines: DataFrame, windows: Windows) -> DataFrame:
    """The nine numbers and the main country."""
    observed = lines.filter(in_observation(windows))
    return behaviour(lines, windows).join(main_country(observed), "CustomerID", "left")


def labelled_features(qualified: DataFrame, windows: Windows) -> DataFrame:
    """Features and label of eligible customers, before scoring.

    One aggregation over both windows gives eligibility, features and label together, so no id list is built
    and the lines are not joined to it. The country comes from a second, narrow read of three columns; both
    sides are already placed by CustomerID when they meet.
    """
    seen, later = in_observation(windows), in_future(windows)
    lines = qualified.filter(F.col("CustomerID").isNotNull() & (seen | later))
    bought = F.count_if(later).alias("later_lines")
    summary = _summary(lines, seen, bought).filter(is_eligible(windows))
    summary = summary.withColumn(LABEL, F.when(F.col("later_lines") > 0, 0).otherwise(1))
    country = main_country(qualified.filter(seen))
    return _as_features(summary, windows, LABEL).join(country, "CustomerID", "left")


def labelled_behaviour(lines: DataFrame, windows: Windows) -> DataFrame:
    """The nine numbers for every customer with a line up to the snapshot, and the label of eligible ones, else null.

    The same rows as `attach_label` of `behaviour` and `inactivity_label`, from one read of the lines and without a join.
    """
    seen, later = in_observation(windows), in_future(windows)
    known = lines.filter(F.col("CustomerID").isNotNull() & (seen | later))
    summary = _summary(known, seen, F.count_if(later).alias("later_lines")).filter(F.col("first").isNotNull())
    label = F.when(is_eligible(windows), F.when(F.col("later_lines") > 0, 0).otherwise(1))
    return _as_features(summary.withColumn(LABEL, label), windows, LABEL)


def customer_table(labelled: DataFrame) -> DataFrame:
    """The 17-column customer table. `labelled` is read several times, so it should be a stored table."""
    return add_rfm_scores(labelled).select(*FEATURE_COLUMNS)


def attach_label(features: DataFrame, labels: DataFrame) -> DataFrame:
    return features.join(labels.select("CustomerID", LABEL), "CustomerID", "left")
