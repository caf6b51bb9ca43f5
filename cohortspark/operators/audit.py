"""Data-quality measures of raw and cleaned lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.config import Windows
from cohortspark.functions.columns import between_days, in_observation, is_cancellation, percent, qualifies
from cohortspark.functions.quantiles import quantiles
from cohortspark.operators.cleaning import line_copies

# Older names that still resolve.
AUDIT_ALIASES = {
    "total_rows": "raw_rows",
    "cancellation_invoices": "cancellation_rows",
    "non_positive_quantity": "non_positive_quantity_rows",
    "non_positive_unit_price": "non_positive_unit_price_rows",
}
# Measures of the written audit, in file order, with their source names.
AUDIT_FILE = {
    "raw_rows": "raw_rows",
    "raw_columns": "raw_columns",
    "duplicate_rows": "exact_duplicates",
    "missing_customer_id": "missing_customer_id",
    "missing_description": "missing_description",
    "cancellation_rows": "cancellation_rows",
    "non_positive_quantity_rows": "non_positive_quantity_rows",
    "non_positive_unit_price_rows": "non_positive_unit_price_rows",
    "negative_quantity_rows": "negative_quantity_rows",
    "zero_quantity_rows": "zero_quantity_rows",
    "negative_unit_price_rows": "negative_unit_price_rows",
    "zero_unit_price_rows": "zero_unit_price_rows",
    "date_min": "date_min",
    "date_max": "date_max",
    "unique_invoices": "unique_invoices",
    "unique_products": "unique_products",
    "unique_customers": "unique_customers",
    "country_count": "country_count",
}


# The measures in their order.
AUDIT_MEASURES = [
    "raw_rows", "raw_columns", "missing_customer_id", "missing_description", "exact_duplicates", "cancellation_rows",
    "negative_quantity_rows", "zero_quantity_rows", "non_positive_quantity_rows", "negative_unit_price_rows",
    "zero_unit_price_rows", "non_positive_unit_price_rows", "date_parse_failures", "date_min", "date_max",
    "unique_invoices", "unique_products", "unique_customers", "country_count",
]
AUDIT_KEYS = {"unique_invoices": "InvoiceNo", "unique_products": "StockCode", "unique_customers": "CustomerID", "country_count": "Country"}


def plain_counts(raw: DataFrame) -> DataFrame:
    """The measures that need no grouping: one row from one read, summed within each task."""
    quantity, price = F.col("Quantity"), F.col("UnitPrice")
    conditions = {
        "missing_customer_id": F.col("CustomerID").isNull(),
        "missing_description": F.col("Description").isNull(),
        "cancellation_rows": is_cancellation(),
        "negative_quantity_rows": quantity < 0,
        "zero_quantity_rows": quantity == 0,
        "non_positive_quantity_rows": quantity <= 0,
        "negative_unit_price_rows": price < 0,
        "zero_unit_price_rows": price == 0,
        "non_positive_unit_price_rows": price <= 0,
        "date_parse_failures": F.col("InvoiceDate").isNull(),
    }
    days = {"date_min": F.min("InvoiceDate"), "date_max": F.max("InvoiceDate")}
    return raw.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.lit(len(raw.columns)).alias("raw_columns"),
        *[F.count_if(condition).alias(name) for name, condition in conditions.items()],
        *[F.to_date(day).cast("string").alias(name) for name, day in days.items()],
    )


def distinct_keys(raw: DataFrame) -> DataFrame:
    """Distinct values of the four keys: pairs of key and value, equal ones collapsing before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("string").alias("v")) for i, c in enumerate(AUDIT_KEYS.values())])
    pairs = raw.select(F.inline(pairs)).filter(F.col("v").isNotNull()).distinct()
    return pairs.agg(*[F.count_if(F.col("k") == i).alias(name) for i, name in enumerate(AUDIT_KEYS)])


def audit(raw: DataFrame) -> DataFrame:
    """Nineteen measures of the raw lines as one row.

    Plain counts, distinct keys and whole-row duplicates are aggregates of their own over the columns that each
    needs, so only the duplicates shuffle whole rows, and a selection of other measures does not compute them.
    """
    grouped = {name: distinct_keys(raw).select(name).scalar() for name in AUDIT_KEYS}
    grouped["exact_duplicates"] = duplicate_rows(raw).select(F.coalesce("duplicate_rows", F.lit(0)).cast("bigint")).scalar()
    return plain_counts(raw).withColumns(grouped).select(*AUDIT_MEASURES)


def with_aliases(audited: DataFrame) -> DataFrame:
    return audited.withColumns({old: F.col(new) for old, new in AUDIT_ALIASES.items()})


def audit_report(raw: DataFrame, qualified: DataFrame) -> DataFrame:
    """The audit file: eighteen raw measures plus size and customers of the qualified table."""
    size = qualified.agg(
        F.struct(F.count(F.lit(1)).alias("rows"), F.countDistinct("CustomerID").alias("customers")).alias("size")
    )
    return (
        audit(raw)
        .select(*[F.col(source).alias(name) for name, source in AUDIT_FILE.items()])
        .withColumn("_size", size.scalar())
        .withColumns({"qualified_rows": F.col("_size.rows"), "qualified_customers": F.col("_size.customers")})
        .drop("_size")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows, and their share in percent."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    rows, extra = F.sum("_copies"), F.sum(F.col("_copies") - 1)
    return copies.agg(extra.alias("duplicate_rows"), percent(extra, rows, 3).alias("duplicate_pct"))


def missing_values(df: DataFrame) -> DataFrame:
    """Null count and percent of every column that has nulls."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)]
    )
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"_{i}").alias("missing_count"),
            percent(F.col(f"_{i}"), F.col("_rows"), 2).alias("missing_pct"),
        )
        for i, c in enumerate(df.columns)
    ]
    return counts.select(F.inline(F.array(*cells))).filter(F.col("missing_count") > 0)


def column_types(df: DataFrame) -> DataFrame:
    """Name, type and place of every column, with the row count."""
    cells = [
        F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("column"), F.lit(kind).alias("type"))
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.inline(F.array(*cells)))


def top_countries(df: DataFrame, k: int = 5) -> DataFrame:
    counts = df.filter(F.col("Country").isNotNull()).groupBy("Country").agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.col("rows").desc(), "Country").limit(k)


def cancellation_share(df: DataFrame) -> DataFrame:
    cancelled = F.count_if(is_cancellation())
    return df.agg(cancelled.alias("cancellation_rows"), percent(cancelled, F.count(F.lit(1)), 2).alias("cancellation_pct"))


def cancelled_countries(df: DataFrame, k: int = 5) -> DataFrame:
    return top_countries(df.filter(is_cancellation()), k)


def sign_profile(df: DataFrame, columns: tuple[str, ...] = ("Quantity", "UnitPrice")) -> DataFrame:
    tests = {"negative": lambda c: c < 0, "zero": lambda c: c == 0, "positive": lambda c: c > 0}
    counts = df.agg(*[F.count_if(test(F.col(c))).alias(f"{c}_{t}") for c in columns for t, test in tests.items()])
    cells = [F.struct(F.lit(c).alias("column"), *[F.col(f"{c}_{t}").alias(t) for t in tests]) for c in columns]
    return counts.select(F.inline(F.array(*cells)))


def describe(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum of each column."""
    quartiles = quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    wide = df.agg(
        *[
            a
            for i, c in enumerate(columns)
            for a in (
                F.count(c).alias(f"n{i}"),
                F.avg(c).alias(f"m{i}"),
                F.stddev_samp(c).alias(f"s{i}"),
                F.min(c).cast("double").alias(f"l{i}"),
                F.max(c).cast("double").alias(f"h{i}"),
            )
        ]
    )
    cells = []
    for i, c in enumerate(columns):
        q = [F.lit(x).cast("double") for x in quartiles[c]]
        stats = {"mean": F.col(f"m{i}"), "std": F.col(f"s{i}"), "min": F.col(f"l{i}")}
        stats |= {"q25": q[0], "q50": q[1], "q75": q[2], "max": F.col(f"h{i}")}
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("count"),
                *[F.round(v, digits).alias(name) for name, v in stats.items()],
            )
        )
    return wide.select(F.inline(F.array(*cells)))


def duplicates_of(copies: DataFrame) -> DataFrame:
    """What `duplicate_rows` gives for raw lines, from their stored copies (`cleaning.line_copies`)."""
    described = F.col("_copies") - F.col("_unfilled")
    different = F.when(F.col("_unfilled") > 0, 1).otherwise(0) + F.when(described > 0, 1).otherwise(0)
    rows, extra = F.sum("_copies"), F.sum(F.col("_copies") - different)
    return copies.agg(extra.alias("duplicate_rows"), percent(extra, rows, 3).alias("duplicate_pct"))


def stage_counts(raw: DataFrame) -> DataFrame:
    return stage_counts_of(line_copies(raw))


def stage_counts_of(copies: DataFrame) -> DataFrame:
    """Rows after each cleaning stage, from the copies of the filled lines."""
    counts = copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("raw_rows"),
        F.count(F.lit(1)).alias("deduplicated_rows"),
        F.count_if(qualifies()).alias("qualified_rows"),
    )
    return counts.select(
        "raw_rows",
        "deduplicated_rows",
        (F.col("raw_rows") - F.col("deduplicated_rows")).alias("duplicates_removed"),
        "qualified_rows",
        (F.col("deduplicated_rows") - F.col("qualified_rows")).alias("removed_by_cleaning"),
    )


def after_deduplication(raw: DataFrame) -> DataFrame:
    return after_deduplication_of(line_copies(raw))


def after_deduplication_of(copies: DataFrame) -> DataFrame:
    """Counts on the de-duplicated lines, one per reason a line may not qualify."""
    return copies.agg(
        F.count_if(is_cancellation()).alias("cancellations"),
        F.count_if(~is_cancellation()).alias("not_cancellations"),
        F.count_if(F.col("Quantity") <= 0).alias("non_positive_quantity"),
        F.count_if(F.col("UnitPrice") <= 0).alias("non_positive_price"),
        F.count_if(F.col("CustomerID").isNull()).alias("missing_customer"),
    )


def revenue_check(qualified: DataFrame) -> DataFrame:
    return qualified.agg(
        F.min("Revenue").alias("min_revenue"),
        F.max("Revenue").alias("max_revenue"),
        F.count_if(F.col("Revenue") < 0).alias("negative_revenue"),
    )


def output_check(qualified: DataFrame) -> DataFrame:
    """Size of the written table and the violations in it, all of which must be zero."""
    return qualified.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("CustomerID").isNull()).alias("missing_customer"),
        F.count_if(F.col("Quantity") <= 0).alias("non_positive_quantity"),
        F.count_if(F.col("UnitPrice") <= 0).alias("non_positive_price"),
        F.count_if(F.col("Revenue") < 0).alias("negative_revenue"),
    )


def window_summary(qualified: DataFrame, windows: Windows) -> DataFrame:
    """Lines, date range and distinct customers of the observation and label windows, in one pass."""
    label = F.when(in_observation(windows), "observation").when(
        between_days(windows.future_start, windows.future_end), "future"
    )
    return (
        qualified.withColumn("window", label)
        .filter(F.col("window").isNotNull())
        .groupBy("window")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.to_date(F.min("InvoiceDate")).alias("first_day"),
            F.to_date(F.max("InvoiceDate")).alias("last_day"),
            F.countDistinct("CustomerID").alias("customers"),
        )
    )
