"""Customer lookup, filtered directory and cohort figures."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.config import SEGMENTS
from cohortspark.functions.columns import exact_sum, percent_text, position_in, pounds

# Columns of the directory.
DIRECTORY_COLUMNS = [
    "Country",
    "Recency",
    "Frequency",
    "Monetary",
    "AvgOrderValue",
    "UniqueProducts",
    "TotalItems",
    "ActiveMonths",
    "TenureDays",
    "PurchaseSpanDays",
    "RFM_Score",
    "RFM_Segment",
    "Churn_Probability",
    "Risk_Tier",
    "Retention_Priority",
]


def _any_of(choices: dict[str, Sequence[str]], columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for column, values in choices.items():
        if values and column in columns:
            condition = condition & F.col(column).isin(*values)
    return condition


def directory_filter(
    risk: DataFrame, countries: Sequence[str] = (), tiers: Sequence[str] = (), segments: Sequence[str] = ()
) -> DataFrame:
    """An empty list does not filter; the others must all hold."""
    return risk.filter(_any_of({"Country": countries, "Risk_Tier": tiers, "RFM_Segment": segments}, risk.columns))


def cohort_filter(
    table: DataFrame,
    recency: tuple[float, float] | None = None,
    monetary: tuple[float, float] | None = None,
    countries: Sequence[str] = (),
    segments: Sequence[str] = (),
) -> DataFrame:
    condition = _any_of({"Country": countries, "RFM_Segment": segments}, table.columns)
    for column, span in (("Recency", recency), ("Monetary", monetary)):
        if span is not None:
            condition = condition & F.col(column).between(*span)
    return table.filter(condition)


def country_options(table: DataFrame) -> DataFrame:
    return table.select("Country").filter(F.col("Country").isNotNull()).distinct().orderBy("Country")


def segment_options(table: DataFrame) -> DataFrame:
    present = table.select("RFM_Segment").filter(F.col("RFM_Segment").isin(*SEGMENTS)).distinct()
    return present.withColumn("position", position_in("RFM_Segment", SEGMENTS)).orderBy("position")


def range_options(table: DataFrame) -> DataFrame:
    return table.agg(
        *[f(c).alias(f"{n}_{c.lower()}") for c in ("Recency", "Monetary") for n, f in (("min", F.min), ("max", F.max))]
    )


def lookup(risk: DataFrame, customer) -> DataFrame:
    """The customer's row; ids may be text, whole or decimal. Anything else gives no row, same columns."""
    try:
        number = Decimal(str(customer).strip())
    except InvalidOperation:
        number = Decimal("nan")
    if not number.is_finite() or number != number.to_integral_value() or abs(number) >= 2**63:
        return risk.filter(F.lit(False))
    return risk.filter(F.col("CustomerID") == F.lit(int(number)).cast("bigint"))


def directory(risk: DataFrame) -> DataFrame:
    """Display columns that exist, money and percent as text."""
    text = {
        "Monetary": pounds("Monetary", 0),
        "AvgOrderValue": pounds("AvgOrderValue", 2),
        "Churn_Probability": percent_text(F.col("Churn_Probability")) if "Churn_Probability" in risk.columns else None,
    }
    shown = [c for c in DIRECTORY_COLUMNS if c in risk.columns]
    return risk.select("CustomerID", *[text[c].alias(c) if c in text else F.col(c) for c in shown])


def profile(row: DataFrame) -> DataFrame:
    """Profile card values of the given customers, with the card's placeholders for gaps."""

    def text(column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit("—"))

    def number(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    quintiles = F.concat_ws("/", *[text(F.col(c)) for c in ("R", "F", "M")])
    return row.select(
        "CustomerID",
        text(F.col("Country")).alias("Country"),
        F.concat(number("Recency").cast("string"), F.lit("d")).alias("Recency"),
        number("Frequency").cast("string").alias("Frequency"),
        pounds(number("Monetary")).alias("Monetary"),
        pounds(number("AvgOrderValue"), 2).alias("AvgOrderValue"),
        number("ActiveMonths").cast("string").alias("ActiveMonths"),
        text(F.col("RFM_Score")).alias("RFM_Score"),
        quintiles.alias("Quintiles"),
        text(F.col("RFM_Segment")).alias("RFM_Segment"),
        text(percent_text(F.col("Churn_Probability"))).alias("Churn_Probability"),
        text(F.col("Risk_Tier")).alias("Risk_Tier"),
        text(F.col("Retention_Priority")).alias("Retention_Priority"),
    )


def cohort_kpis(filtered: DataFrame) -> DataFrame:
    return filtered.agg(
        F.count(F.lit(1)).alias("customers"),
        exact_sum("Monetary").alias("revenue"),
        F.round(F.avg("AvgOrderValue"), 4).alias("mean_order_value"),
        F.round(F.avg("Recency"), 4).alias("mean_recency"),
    )


def tier_counts(filtered: DataFrame) -> DataFrame:
    return filtered.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("Risk_Tier") == "High Risk").alias("high_risk"),
        F.count_if(F.col("Risk_Tier") == "Medium Risk").alias("medium_risk"),
        F.count_if(F.col("Risk_Tier") == "Low Risk").alias("low_risk"),
    )


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)
