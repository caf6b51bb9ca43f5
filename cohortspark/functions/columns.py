"""Column helpers shared by the operators. All are native expressions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortspark.config import Windows


def midnight(day: date) -> Column:
    return F.expr(f"timestamp_ntz'{day.isoformat()} 00:00:00'")


def up_to(day: date, column: str = "InvoiceDate") -> Column:
    """Calendar date on or before `day`, written as a bare comparison so that it reaches the file scan."""
    return F.col(column) < midnight(day + timedelta(days=1))


def between_days(first: date, last: date, column: str = "InvoiceDate") -> Column:
    return (F.col(column) >= midnight(first)) & up_to(last, column)


def in_observation(windows: Windows) -> Column:
    return up_to(windows.snapshot)


def in_future(windows: Windows) -> Column:
    return between_days(windows.future_start, windows.future_end)


def is_cancellation(column: str = "InvoiceNo") -> Column:
    """Case-sensitive prefix C; a missing invoice number is not a cancellation."""
    return F.coalesce(F.col(column).startswith("C"), F.lit(False))


def exact_sum(column: str | Column) -> Column:
    """Sum of money, independent of row order, so a recomputed task gives the same total.

    Lines are added up with eight decimal places, beyond which a double holds noise; totals may have 30 digits before
    the point.
    """
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(column.cast("decimal(38,8)")).cast("double")


def qualifies() -> Column:
    """A purchase: known customer, not a cancellation, positive quantity and price. Not-a-number is no price."""
    price = F.coalesce(F.nanvl(F.col("UnitPrice").cast("double"), F.lit(0.0)) > 0, F.lit(False))
    return F.col("CustomerID").isNotNull() & ~is_cancellation() & (F.col("Quantity") > 0) & price


def elapsed_days(first: str, last: str) -> Column:
    """Whole 24-hour periods between two timestamps, whatever the session's time zone."""
    return F.expr(f"extract(DAY FROM ({last} - {first}))")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def percent(numerator: Column, denominator: Column, digits: int) -> Column:
    return F.bround(F.try_divide(numerator.cast("double"), denominator.cast("double")) * 100, digits)


def pounds(column: str | Column, digits: int = 0) -> Column:
    return F.concat(F.lit("£"), F.format_number(column, digits))


def percent_text(column: Column, digits: int = 1) -> Column:
    """A value that is already in percent, as text; ties round to even, as with money."""
    return F.concat(F.format_number(column, digits), F.lit("%"))


def position_in(column: str, names: list[str]) -> Column:
    """1-based place of a category in its reporting order."""
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)).cast("int")
