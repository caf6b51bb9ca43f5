"""Who is eligible, and whether they bought again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.config import LABEL, Windows
from cohortspark.functions.columns import elapsed_days, in_future, in_observation


def observation_lines(qualified: DataFrame, windows: Windows) -> DataFrame:
    return qualified.filter(in_observation(windows))


def future_lines(qualified: DataFrame, windows: Windows) -> DataFrame:
    return qualified.filter(in_future(windows))


def is_eligible(windows: Windows) -> F.Column:
    """On `invoices`, `first` and `last`: enough invoices, and enough whole 24-hour days between the ends."""
    return (F.col("invoices") >= windows.min_invoices) & (elapsed_days("first", "last") >= windows.min_span_days)


def eligible_customers(qualified: DataFrame, windows: Windows) -> DataFrame:
    """Ids of eligible customers, judged on the observation window only."""
    observed = observation_lines(qualified, windows).filter(F.col("CustomerID").isNotNull())
    histories = observed.groupBy("CustomerID").agg(
        F.countDistinct("InvoiceNo").alias("invoices"), F.min("InvoiceDate").alias("first"), F.max("InvoiceDate").alias("last")
    )
    return histories.filter(is_eligible(windows)).select("CustomerID")


# Lines of a customer are placed in up to this many slices by their invoice, whatever the size of the table.
SLICES = 1024
SLICE = "_slice"


def with_slice(lines: DataFrame) -> DataFrame:
    """Adds the slice of each line's invoice, unless the table was stored with it. An invoice has one slice."""
    if SLICE in lines.columns:
        return lines
    return lines.withColumn(SLICE, F.pmod(F.xxhash64("InvoiceNo"), F.lit(SLICES)).cast("int"))


def lines_of_eligible(qualified: DataFrame, windows: Windows) -> DataFrame:
    """All lines of eligible customers, later ones included.

    Customers are met slice by slice: distinct invoices add up over the slices, as an invoice has one, and the verdict
    goes back to the slices that occur, of which there are no more than invoices. So a customer with a large part of
    all lines is divided among many tasks without being looked for, and nothing runs while the plan is built. Of a
    table that is stored by customer and slice (`Pipeline.by_customer`) no line is shuffled.
    """
    known = with_slice(qualified).filter(F.col("CustomerID").isNotNull())
    seen = in_observation(windows)
    when = F.when(seen, F.col("InvoiceDate"))
    slices = known.groupBy("CustomerID", SLICE).agg(
        F.countDistinct(F.when(seen, F.col("InvoiceNo"))).alias("_invoices"), F.min(when).alias("_first"), F.max(when).alias("_last")
    )
    customer = Window.partitionBy("CustomerID")
    histories = slices.select(
        "CustomerID",
        SLICE,
        F.sum("_invoices").over(customer).alias("invoices"),
        F.min("_first").over(customer).alias("first"),
        F.max("_last").over(customer).alias("last"),
    )
    eligible = histories.filter(is_eligible(windows)).select("CustomerID", SLICE)
    return known.join(eligible, ["CustomerID", SLICE], "left_semi").select([c for c in qualified.columns if c != SLICE])


def inactivity_label(qualified: DataFrame, customers: DataFrame, windows: Windows) -> DataFrame:
    """1 for a customer without a purchase in the label window, else 0; one row per given customer."""
    buyers = future_lines(qualified, windows).select("CustomerID").distinct().withColumn("_bought", F.lit(True))
    return customers.join(buyers, "CustomerID", "left").select(
        "CustomerID", F.when(F.col("_bought").isNull(), 1).otherwise(0).alias(LABEL)
    )
