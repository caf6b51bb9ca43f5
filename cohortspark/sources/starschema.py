"""Invoice lines derived from order tables, so that the pipeline can run where no retail export is at hand.

Every order line becomes one invoice line. Blemishes of real exports are put in by rule: cancellations, zero
quantities and prices, missing customers and descriptions, and repeated lines. No line is left out.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.config import Windows

# Study dates that suit the order tables. LATE spreads frequencies, EARLY ties them.
LATE = Windows(date(2000, 12, 31), date(2001, 1, 1), date(2001, 3, 31))
EARLY = Windows(date(1996, 12, 31), date(1997, 1, 1), date(1997, 3, 31))
# Study dates for the event stream, which covers one month.
EVENT_MONTH = Windows(date(2024, 1, 20), date(2024, 1, 21), date(2024, 1, 30), min_span_days=7)


def invoice_lines(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with its order, part and supplier country, in the raw invoice-line layout."""

    def table(name):
        return spark.read.parquet(f"{folder}/{name}.parquet")

    # Join sides are left to the planner, which broadcasts only what it has sized.
    lines = (
        table("lineitem")
        .join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(table("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
        .join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    )
    returned = F.col("l_returnflag") == "R"
    units = F.col("l_quantity").cast("bigint")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    copies = F.when(F.col("l_orderkey") % 97 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return lines.withColumn("copy", F.explode(copies)).select(
        F.concat(F.when(returned, "C").otherwise(""), F.col("o_orderkey").cast("string")).alias("InvoiceNo"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        F.when(F.col("l_partkey") % 50 != 0, F.col("p_name")).alias("Description"),
        F.when(F.col("l_orderkey") % 101 == 0, 0).when(returned, -units).otherwise(units).cast("int").alias("Quantity"),
        F.expr("timestampadd(SECOND, cast((o_orderkey * 7919) % 86400 AS int), o_orderdate)")
        .cast("timestamp_ntz")
        .alias("InvoiceDate"),
        # Price per unit in whole cents, rounded half up in whole numbers.
        F.when(F.col("l_partkey") % 199 == 0, 0.0)
        .otherwise(F.floor((2 * cents + units) / (2 * units)) / 100.0)
        .cast("double")
        .alias("UnitPrice"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("CustomerID"),
        F.col("n_name").alias("Country"),
    )


def purchase_events(spark: SparkSession, folder: str) -> DataFrame:
    """Purchase events as qualified lines: one invoice, one unit each, at their real time of day."""
    events = spark.read.parquet(f"{folder}/events.parquet").filter(F.col("event_type") == "purchase")
    return events.select(
        F.col("event_id").cast("string").alias("InvoiceNo"),
        F.lit("event").alias("StockCode"),
        F.lit("Unknown").alias("Description"),
        F.lit(1).alias("Quantity"),
        F.col("ts").cast("timestamp_ntz").alias("InvoiceDate"),
        F.col("value").alias("UnitPrice"),
        F.col("user_id").alias("CustomerID"),
        F.lit("unknown").alias("Country"),
        F.col("value").alias("Revenue"),
        F.lit(False).alias("IsCancellation"),
    )
