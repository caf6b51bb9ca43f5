"""Risk tiers, retention priorities and inactivity rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.config import LABEL
from cohortspark.functions.quantiles import quantiles

HIGH_PERCENTILE = 0.8
MEDIUM_PERCENTILE = 0.4
DEFAULT_PRIORITY = "Standard engagement"

# Retention priority by risk tier and segment.
PRIORITIES = {
    ("High Risk", "Very High Value"): "Priority retention attention",
    ("High Risk", "High Value"): "Priority retention attention",
    ("High Risk", "Medium Value"): "Targeted attention",
    ("High Risk", "Lower Value"): "Lower-cost intervention",
    ("Medium Risk", "Very High Value"): "Monitor / targeted engagement",
    ("Medium Risk", "High Value"): "Monitor / targeted engagement",
    ("Medium Risk", "Medium Value"): "Standard engagement",
    ("Medium Risk", "Lower Value"): "Standard engagement",
    ("Low Risk", "Very High Value"): "Relationship / loyalty attention",
    ("Low Risk", "High Value"): "Relationship / loyalty attention",
    ("Low Risk", "Medium Value"): "Standard engagement",
    ("Low Risk", "Lower Value"): "Standard engagement",
}


def risk_tiers(
    df: DataFrame,
    probability: str = "Churn_Probability_Raw",
    high: float = HIGH_PERCENTILE,
    medium: float = MEDIUM_PERCENTILE,
) -> DataFrame:
    """Adds Risk_Tier from percentiles of all probabilities. A missing probability stops the query."""
    medium_edge, high_edge = quantiles(df, {probability: [medium, high]})[probability]
    p = F.col(probability)
    missing = F.raise_error(F.lit(f"{probability} is missing for a customer")).cast("string")
    tier = (
        F.when(p.isNull() | F.isnan(p), missing)
        .when(p >= F.lit(high_edge), "High Risk")
        .when(p >= F.lit(medium_edge), "Medium Risk")
        .otherwise("Low Risk")
    )
    return df.withColumn("Risk_Tier", tier)


def retention_priority(tier: str = "Risk_Tier", segment: str = "RFM_Segment") -> Column:
    """Twelve rules as one CASE; any other pair gets the default."""
    chain = F.lit(DEFAULT_PRIORITY)
    for (t, s), priority in PRIORITIES.items():
        if priority != DEFAULT_PRIORITY:
            chain = F.when((F.col(tier) == t) & (F.col(segment) == s), priority).otherwise(chain)
    return chain


def enrich(scored: DataFrame) -> DataFrame:
    """Percent probability, tier and priority beside Churn_Probability_Raw; without segments all get the default."""
    percent = scored.withColumn("Churn_Probability", F.bround(F.col("Churn_Probability_Raw") * 100, 2))
    tiered = risk_tiers(percent)
    known = "RFM_Segment" in scored.columns
    return tiered.withColumn("Retention_Priority", retention_priority() if known else F.lit(DEFAULT_PRIORITY))


def risk_table(features: DataFrame, probabilities: DataFrame | None = None) -> DataFrame:
    """Features with percent probability, tier and priority; the raw probability is dropped.

    `probabilities` (CustomerID, Churn_Probability_Raw) is joined on when the features do not carry it yet.
    """
    if probabilities is not None:
        features = features.join(probabilities.select("CustomerID", "Churn_Probability_Raw"), "CustomerID", "left")
    result = enrich(features).drop("Churn_Probability_Raw")
    return result if "RFM_Segment" in features.columns else result.drop("Retention_Priority")


def rate_by_group(df: DataFrame, group: str, label: str = LABEL) -> DataFrame:
    """Customers with a label, inactive ones and their share; rows without a group are left out."""
    return (
        df.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.count(label).alias("n"), F.sum(label).cast("bigint").alias("churned"))
        .withColumn("churn_rate", F.try_divide(F.col("churned").cast("double"), F.col("n").cast("double")))
    )


def coefficient_direction(coefficient: str = "coefficient") -> Column:
    return F.when(F.col(coefficient) > 0, "Higher Inactivity Risk (+)").otherwise("Lower Inactivity Risk (-)")
