"""From raw invoice lines to qualifying purchases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.columns import is_cancellation, qualifies


def fill_descriptions(df: DataFrame, text: str = "Unknown") -> DataFrame:
    return df.fillna(text, subset=["Description"])


def line_copies(raw: DataFrame) -> DataFrame:
    """The different filled lines, with how often each occurs and how many of these had no description.

    One shuffle of whole rows, after copies have collapsed in each task, serves whatever asks for duplicates. The two
    counts tell how many different raw lines a filled line comes from: filling makes two equal at most.
    """
    filled = raw.withColumn("_unfilled", F.col("Description").isNull()).transform(fill_descriptions)
    return filled.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("_copies"), F.count_if("_unfilled").alias("_unfilled"))


def distinct_lines(copies: DataFrame) -> DataFrame:
    """The filled lines without their counts, as `drop_exact_duplicates` gives them."""
    return copies.drop("_copies", "_unfilled")


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One copy of every distinct row, nulls equal. Copies collapse before the shuffle."""
    return df.dropDuplicates()


def flag_cancellations(df: DataFrame) -> DataFrame:
    return df.withColumn("IsCancellation", is_cancellation())


def qualifying(df: DataFrame) -> DataFrame:
    """Known customer, not a cancellation, positive quantity and price; Revenue on what remains."""
    return df.filter(qualifies()).withColumn("Revenue", F.col("Quantity") * F.col("UnitPrice"))


def clean(raw: DataFrame) -> DataFrame:
    """Fill, de-duplicate, flag, filter: the order matters, as filling can make rows equal.

    The filter's conditions are on key columns of the de-duplication, so Spark moves them below its shuffle.
    """
    return (
        raw.transform(fill_descriptions)
        .transform(drop_exact_duplicates)
        .transform(flag_cancellations)
        .transform(qualifying)
    )
