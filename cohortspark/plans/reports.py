"""Reporting aggregates over the customer table and the qualified lines.

Categories are few and known, so their tables are conditional aggregates of one pass: every task sends one
row, and no category is a shuffle key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.config import LABEL, SEGMENTS, TIERS, Windows
from cohortspark.functions.bands import (
    DASHBOARD_RECENCY,
    FREQUENCY_BANDS,
    FREQUENCY_GROUPS,
    FREQUENCY_OPEN,
    VALUE_GROUPS,
    dashboard_recency_band,
    equal_width_bin,
    frequency_band,
    notebook_recency_band,
    notebook_recency_bands,
)
from cohortspark.functions.columns import exact_sum, percent, percent_text, position_in, pounds
from cohortspark.functions.quantiles import quantiles
from cohortspark.operators.cohort import future_lines, observation_lines
from cohortspark.operators.insights import rate_by_group
from cohortspark.operators.scoring import frequency_group, value_group
from cohortspark.sources.tables import transactions_for_trends

# Class names and the features of the summary file.
CLASS_NAMES = {0: "Active (0)", 1: "Inactive (1)"}
SUMMARY_COLUMNS = [
    "Recency",
    "Frequency",
    "Monetary",
    "AvgOrderValue",
    "TenureDays",
    "PurchaseSpanDays",
    "ActiveMonths",
    "UniqueProducts",
    "TotalItems",
    "RFM_Score",
]


def by_category(
    df: DataFrame, column: str, names: Sequence, measures: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """One row per given category with its 1-based position; each measure gets the category's condition."""
    if not names:
        return by_category(df, column, [""], measures).limit(0)
    wide = df.agg(
        *[m(F.col(column) == F.lit(n)).alias(f"{k}_{i}") for i, n in enumerate(names) for k, m in measures.items()]
    )
    rows = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(n).alias(column),
            *[F.col(f"{k}_{i}").alias(k) for k in measures],
        )
        for i, n in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*rows)))


def _customers(condition: Column) -> Column:
    return F.count_if(condition)


def _churned(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(LABEL))), F.lit(0)).cast("bigint")


def _labelled(condition: Column) -> Column:
    return F.count(F.when(condition, F.col(LABEL)))


def _share(part: str, total: Column, digits: int) -> Column:
    return percent(F.col(part), total, digits)


# ---------------------------------------------------------------- inactivity rates


def recency_rates(table: DataFrame) -> DataFrame:
    """Dashboard bands; Recency 0 belongs to none and is left out."""
    rates = rate_by_group(table.withColumn("Recency_Band", dashboard_recency_band()), "Recency_Band")
    return rates.withColumn("position", position_in("Recency_Band", [n for _, n in DASHBOARD_RECENCY])).orderBy("position")


def frequency_rates(table: DataFrame) -> DataFrame:
    rates = rate_by_group(frequency_group(table), "Frequency_Group")
    return rates.withColumn("position", position_in("Frequency_Group", FREQUENCY_GROUPS)).orderBy("position")


def value_rates(table: DataFrame) -> DataFrame:
    rates = rate_by_group(value_group(table), "Value_Group")
    return rates.withColumn("position", position_in("Value_Group", VALUE_GROUPS)).orderBy("position")


def _band_rates(table: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    counts = by_category(table, column, names, {"churned": _churned, "total": _labelled}).filter(F.col("total") > 0)
    return counts.withColumn("inactive_rate_pct", _share("churned", F.col("total"), 1))


def recency_band_rates(table: DataFrame) -> DataFrame:
    """Notebook bands, which adapt to the largest recency and include 0."""
    longest = table.agg(F.max("Recency")).first()[0]
    names = [name for _, _, name in notebook_recency_bands(longest)]
    return _band_rates(table.withColumn("RecencyBand", notebook_recency_band(longest)), "RecencyBand", names)


def frequency_band_rates(table: DataFrame) -> DataFrame:
    names = [n for _, n in FREQUENCY_BANDS] + [FREQUENCY_OPEN]
    return _band_rates(table.withColumn("FreqGroup", frequency_band()), "FreqGroup", names)


def extreme_bands(table: DataFrame) -> DataFrame:
    """Bands of highest and lowest inactivity, and the segment with most revenue; ties go to the earlier band."""
    recency, frequency, revenue = recency_band_rates(table), frequency_band_rates(table), segment_revenue(table)

    def pick(df: DataFrame, name: str, by: str, highest: bool) -> Column:
        order = F.struct(F.col(by), -F.col("position")) if highest else F.struct(F.col(by), F.col("position"))
        chosen = F.struct(F.col(name).alias("name"), F.col(by).alias("value"))
        return df.agg((F.max_by if highest else F.min_by)(chosen, order)).scalar()

    one = table.agg(F.count(F.lit(1)).alias("customers"))
    picks = {
        "worst_recency": pick(recency, "RecencyBand", "inactive_rate_pct", True),
        "best_recency": pick(recency, "RecencyBand", "inactive_rate_pct", False),
        "worst_frequency": pick(frequency, "FreqGroup", "inactive_rate_pct", True),
        "top_segment": pick(revenue.filter("customers > 0"), "RFM_Segment", "revenue_share_pct", True),
    }
    filled = one.select("customers", *[p.alias(f"_{k}") for k, p in picks.items()])
    return filled.select(
        "customers",
        *[c for k in picks for c in (F.col(f"_{k}.name").alias(k), F.col(f"_{k}.value").alias(f"{k}_pct"))],
    )


# ---------------------------------------------------------------- segments, tiers, classes


def segment_revenue(table: DataFrame) -> DataFrame:
    """Total, mean, customers and share of revenue per segment, absent segments with no total."""
    measures = {
        "customers": _customers,
        "total_revenue": lambda c: exact_sum(F.when(c, F.col("Monetary"))),
    }
    rows = by_category(table, "RFM_Segment", SEGMENTS, measures)
    # Four rows, hence an unpartitioned frame.
    whole = F.sum("total_revenue").over(Window.partitionBy())
    return rows.withColumn("avg_revenue", F.try_divide(F.col("total_revenue"), F.col("customers").cast("double"))).select(
        "position",
        "RFM_Segment",
        "customers",
        F.round("total_revenue", 4).alias("total_revenue"),
        F.round("avg_revenue", 4).alias("avg_revenue"),
        _share("total_revenue", whole, 1).alias("revenue_share_pct"),
    )


def segment_inactivity(table: DataFrame) -> DataFrame:
    """Customers, inactive, active and inactivity rate of each segment."""
    rows = by_category(table, "RFM_Segment", SEGMENTS, {"customers": _labelled, "churned": _churned})
    return rows.withColumn("active", F.col("customers") - F.col("churned")).withColumn(
        "inactivity_rate_pct", _share("churned", F.col("customers"), 1)
    )


def distribution(table: DataFrame, column: str, names: Sequence, keep_empty: bool = True) -> DataFrame:
    """Customers and share of each category in its fixed order; empty ones as 0, or dropped."""
    rows = by_category(table, column, names, {"customers": _customers})
    whole = F.sum("customers").over(Window.partitionBy())  # one row per category
    rows = rows.withColumn("share_pct", _share("customers", whole, 1))
    return rows if keep_empty else rows.filter(F.col("customers") > 0)


def segment_distribution(table: DataFrame, keep_empty: bool = True) -> DataFrame:
    return distribution(table, "RFM_Segment", SEGMENTS, keep_empty)


def tier_distribution(table: DataFrame, keep_empty: bool = False) -> DataFrame:
    return distribution(table, "Risk_Tier", TIERS, keep_empty)


def score_distribution(table: DataFrame) -> DataFrame:
    return distribution(table, "RFM_Score", range(3, 16))


def class_distribution(table: DataFrame) -> DataFrame:
    rows = distribution(table, LABEL, list(CLASS_NAMES), keep_empty=False)
    name = F.when(F.col(LABEL) == 0, CLASS_NAMES[0]).otherwise(CLASS_NAMES[1])
    return rows.withColumn("class_name", name)


def class_balance(table: DataFrame) -> DataFrame:
    active, inactive = F.count_if(F.col(LABEL) == 0), F.count_if(F.col(LABEL) == 1)
    rows = F.count(F.lit(1))
    return table.agg(
        rows.alias("customers"),
        active.alias("active"),
        inactive.alias("inactive"),
        percent(active, rows, 2).alias("active_pct"),
        percent(inactive, rows, 2).alias("inactive_pct"),
        F.bround(F.try_divide(active.cast("double"), inactive.cast("double")), 2).alias("imbalance_ratio"),
    )


# ---------------------------------------------------------------- distributions


def correlations(table: DataFrame, columns: Sequence[str] = ("Recency", "Frequency", "Monetary"), digits: int = 3) -> DataFrame:
    """Pearson correlation of every pair, long form."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = table.agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    cells = []
    for a in columns:
        for b in columns:
            key = f"{a}~{b}" if (a, b) in pairs else f"{b}~{a}"
            value = F.lit(1.0) if a == b else F.round(F.col(f"`{key}`"), digits)
            cells.append(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), value.alias("correlation")))
    return wide.select(F.inline(F.array(*cells)))


# Columns of the quantile table.
QUANTILE_COLUMNS = ["Recency", "Frequency", "Monetary", "AvgOrderValue", "TenureDays", "PurchaseSpanDays", "ActiveMonths"]


def quantile_table(
    table: DataFrame,
    columns: Sequence[str] = QUANTILE_COLUMNS,
    probabilities: Sequence[float] = (0.10, 0.25, 0.50, 0.75, 0.90),
    digits: int = 1,
) -> DataFrame:
    """Exact quantiles, one row per probability."""
    found = quantiles(table, {c: probabilities for c in columns})
    rows = [(float(p), *[found[c][i] for c in columns]) for i, p in enumerate(probabilities)]
    schema = "probability double, " + ", ".join(f"{c} double" for c in columns)
    raw = table.sparkSession.createDataFrame(rows, schema)
    return raw.select("probability", *[F.bround(c, digits).alias(c) for c in columns])


def box_statistics(table: DataFrame, caps: dict[str, float] | None = None) -> DataFrame:
    """Quartiles and whisker ends (within 1.5 quartile ranges) of capped values, by label."""
    # Caps of the box charts.
    caps = caps or {"Recency": 400, "Frequency": 60, "Monetary": 10000}
    groups = [(label, c) for label in (1, 0) for c in caps]
    capped = table.select(
        *[
            F.when(F.col(LABEL) == label, F.least(F.col(c).cast("double"), F.lit(float(caps[c])))).alias(f"{c}_{label}")
            for label, c in groups
        ]
    )
    found = quantiles(capped, {f"{c}_{label}": [0.25, 0.5, 0.75] for label, c in groups})
    found = {k: q for k, q in found.items() if q[0] is not None}
    ends = capped.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            e
            for k, (q1, _, q3) in found.items()
            for e in (
                F.min(F.when(F.col(k) >= q1 - 1.5 * (q3 - q1), F.col(k))).alias(f"lo_{k}"),
                F.max(F.when(F.col(k) <= q3 + 1.5 * (q3 - q1), F.col(k))).alias(f"hi_{k}"),
                F.count(k).alias(f"n_{k}"),
            )
        ],
    )
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(label).alias(LABEL),
            F.col(f"n_{c}_{label}").alias("customers"),
            F.round(F.col(f"lo_{c}_{label}"), 4).alias("whisker_low"),
            *[F.round(F.lit(x), 4).alias(n) for n, x in zip(("q1", "median", "q3"), found[f"{c}_{label}"])],
            F.round(F.col(f"hi_{c}_{label}"), 4).alias("whisker_high"),
        )
        for label, c in groups
        if f"{c}_{label}" in found
    ]
    return ends.select(F.inline(F.array(*cells)))


def histogram(table: DataFrame, column: str, bins: int, cap: float | None = None, group: str | None = None) -> DataFrame:
    """Customers per equal-width bin, empty bins as 0; with `group`, the filled bins of each group value."""
    value = F.col(column).cast("double")
    value = value if cap is None else F.least(value, F.lit(float(cap)))
    low, high = table.agg(F.coalesce(F.min(value), F.lit(0.0)), F.coalesce(F.max(value), F.lit(0.0))).first()
    bounds = {
        "lower": F.round(F.lit(float(low)) + F.col("bin") * ((high - low) / bins), 6),
        "upper": F.round(F.lit(float(low)) + (F.col("bin") + 1) * ((high - low) / bins), 6),
    }
    keyed = table.filter(value.isNotNull()).withColumn("bin", equal_width_bin(value, low, high, bins))
    keys = [group, "bin"] if group else ["bin"]
    counted = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("customers"))
    if not group:
        every = table.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        counted = every.join(F.broadcast(counted), "bin", "left").fillna(0, subset=["customers"])  # one row per bin
    return counted.withColumns(bounds)


def medians_and_means(table: DataFrame, columns: Sequence[str] = ("Recency", "Frequency", "Monetary")) -> DataFrame:
    middle = quantiles(table, {c: [0.5] for c in columns})
    wide = table.agg(*[F.avg(c).alias(c) for c in columns])
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.round(F.lit(middle[c][0]).cast("double"), 4).alias("median"),
            F.round(F.col(c), 4).alias("mean"),
        )
        for c in columns
    ]
    return wide.select(F.inline(F.array(*cells)))


def scatter(table: DataFrame, x: str, y: str, caps: dict[str, float] | None = None, colour: str = "RFM_Segment") -> DataFrame:
    """Points of a scatter chart, values capped where a cap is given."""
    caps = caps or {}

    def axis(c):
        return F.least(F.col(c).cast("double"), F.lit(float(caps[c]))) if c in caps else F.col(c).cast("double")

    return table.select("CustomerID", axis(x).alias(x), axis(y).alias(y), colour)


# ---------------------------------------------------------------- executive page


def executive_kpis(risk: DataFrame, qualified: DataFrame, windows: Windows) -> DataFrame:
    """Identified and eligible customers, revenue, and the high-risk part of both."""
    high = F.col("Risk_Tier") == "High Risk"
    identified = transactions_for_trends(qualified, windows).agg(F.countDistinct("CustomerID").alias("n"))
    kpis = risk.agg(
        F.count(F.lit(1)).alias("eligible_customers"),
        exact_sum("Monetary").alias("historical_revenue"),
        F.count_if(high).alias("high_risk_customers"),
        F.coalesce(exact_sum(F.when(high, F.col("Monetary"))), F.lit(0.0)).alias("high_risk_revenue"),
    )
    return kpis.select(
        identified.scalar().alias("identified_customers"),
        "*",
        percent(F.col("high_risk_customers"), F.col("eligible_customers"), 1).alias("high_risk_pct"),
        percent(F.col("high_risk_revenue"), F.col("historical_revenue"), 1).alias("high_risk_revenue_pct"),
    )


def monthly_revenue(qualified: DataFrame, windows: Windows) -> DataFrame:
    lines = transactions_for_trends(qualified, windows)
    return (
        lines.groupBy(F.trunc("InvoiceDate", "MM").alias("month")).agg(exact_sum("Revenue").alias("revenue")).orderBy("month")
    )


def country_revenue(qualified: DataFrame, windows: Windows, k: int = 10) -> DataFrame:
    """The k countries with most revenue up to the snapshot."""
    lines = transactions_for_trends(qualified, windows).filter(F.col("Country").isNotNull())
    totals = lines.groupBy("Country").agg(exact_sum("Revenue").alias("revenue"))
    return totals.orderBy(F.col("revenue").desc(), "Country").limit(k)


def executive_insights(risk: DataFrame) -> DataFrame:
    """The figures of the insight panel, percentages also as text with one decimal."""
    high = F.col("Risk_Tier") == "High Risk"
    segments = by_category(risk, "RFM_Segment", SEGMENTS, {"customers": _customers}).agg(
        F.max_by(F.struct("RFM_Segment", "customers"), F.struct(F.col("customers"), -F.col("position")))
    )
    base = risk.agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg(LABEL).alias("rate"),
        F.count_if(high).alias("high_risk_customers"),
        F.coalesce(exact_sum(F.when(high, F.col("Monetary"))), F.lit(0.0)).alias("high_risk_revenue"),
        exact_sum("Monetary").alias("revenue"),
    ).withColumn("top", segments.scalar())

    def share(part: Column, whole: Column) -> Column:
        return percent_text(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * 100, F.lit(0.0)))

    return base.select(
        percent_text(F.col("rate") * 100).alias("inactivity_rate"),
        "high_risk_customers",
        share(F.col("high_risk_customers"), F.col("customers")).alias("high_risk_share"),
        pounds("high_risk_revenue").alias("high_risk_revenue"),
        share(F.col("high_risk_revenue"), F.col("revenue")).alias("high_risk_revenue_share"),
        F.col("top.RFM_Segment").alias("dominant_segment"),
        F.col("top.customers").alias("dominant_customers"),
        share(F.col("top.customers"), F.col("customers")).alias("dominant_share"),
    )


# ---------------------------------------------------------------- summary file


def summary_report(table: DataFrame, qualified: DataFrame, windows: Windows, digits: int = 4) -> DataFrame:
    """One row: window dates and sizes, score and segment counts, class counts, and ten feature summaries."""
    middle = quantiles(table, {c: [0.5] for c in SUMMARY_COLUMNS})
    scores = [F.count_if(F.col("RFM_Score") == s) for s in range(3, 16)]
    segments = [F.count_if(F.col("RFM_Segment") == s) for s in SEGMENTS]
    active, inactive, rows = F.count_if(F.col(LABEL) == 0), F.count_if(F.col(LABEL) == 1), F.count(F.lit(1))

    def present(names, counts):
        entries = [F.struct(F.lit(str(n)).alias("key"), c.alias("value")) for n, c in zip(names, counts)]
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"] > 0))

    def summary(c):
        return F.struct(
            F.bround(F.min(c).cast("double"), digits).alias("min"),
            F.bround(F.max(c).cast("double"), digits).alias("max"),
            F.bround(F.avg(c), digits).alias("mean"),
            F.bround(F.lit(middle[c][0]).cast("double"), digits).alias("median"),
        )

    sizes = {
        "observation_transaction_rows": observation_lines(qualified, windows),
        "future_transaction_rows": future_lines(qualified, windows),
    }
    body = table.agg(
        rows.alias("eligible_customers"),
        present(range(3, 16), scores).alias("rfm_score_distribution"),
        present(SEGMENTS, segments).alias("rfm_segment_counts"),
        F.struct(
            active.alias("class_0_count"),
            inactive.alias("class_1_count"),
            F.coalesce(percent(active, rows, 4), F.lit(0.0)).alias("class_0_pct"),
            F.coalesce(percent(inactive, rows, 4), F.lit(0.0)).alias("class_1_pct"),
            inactive.alias("future_inactive_count"),
            active.alias("future_active_count"),
        ).alias("churn_90d"),
        F.struct(*[summary(c).alias(c) for c in SUMMARY_COLUMNS]).alias("rfm_feature_summary"),
    )
    return body.select(
        F.lit(windows.snapshot.isoformat()).alias("snapshot_date"),
        F.lit(windows.snapshot.isoformat()).alias("observation_end"),
        F.lit(windows.future_start.isoformat()).alias("future_start"),
        F.lit(windows.future_end.isoformat()).alias("future_end"),
        *[df.agg(F.count(F.lit(1))).scalar().alias(name) for name, df in sizes.items()],
        "*",
    )


def _item(prefix: str):
    def row(e):
        return F.struct(F.concat(F.lit(prefix), e["key"]).alias("item"), e["value"].cast("double").alias("value"))

    return row


def flat_summary(report: DataFrame) -> DataFrame:
    """The summary as (item, value) rows."""
    plain = [c for c, t in report.dtypes if t in ("bigint", "int")]
    pairs = [F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in plain]
    for c in ("class_0_count", "class_1_count", "class_0_pct", "class_1_pct"):
        pairs.append(F.struct(F.lit(c).alias("item"), F.col(f"churn_90d.{c}").cast("double").alias("value")))
    for c in SUMMARY_COLUMNS:
        for s in ("min", "max", "mean", "median"):
            cell = F.col(f"rfm_feature_summary.{c}.{s}")
            pairs.append(F.struct(F.lit(f"{c}_{s}").alias("item"), cell.cast("double").alias("value")))
    maps = [
        F.transform(
            F.map_entries(m),
            _item(p),
        )
        for m, p in (("rfm_score_distribution", "score "), ("rfm_segment_counts", "segment "))
    ]
    return report.select(F.inline(F.concat(F.array(*pairs), *maps)))
