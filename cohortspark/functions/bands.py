"""Bands over known or computed edges, as plain CASE expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the bands.
DASHBOARD_RECENCY = [(30, "≤30d"), (60, "31–60d"), (90, "61–90d"), (120, "91–120d"), (180, "121–180d"), (9999, ">180d")]
FREQUENCY_BANDS = [(3, "2–3"), (6, "4–6"), (10, "7–10"), (20, "11–20")]
FREQUENCY_OPEN = ">20"
FREQUENCY_GROUPS = ["Q1 (Lowest)", "Q2", "Q3", "Q4 (Highest)"]
VALUE_GROUPS = ["Bottom 25%", "25–50%", "50–75%", "Top 25%"]
RECENCY_DAYS = (30, 90, 180, 270, 365)


def upper_bands(value: Column, bands: Sequence[tuple], otherwise: str | None = None) -> Column:
    """First label whose upper edge is not exceeded."""
    chain = F.lit(otherwise)
    for edge, label in reversed(bands):
        chain = F.when(value <= edge, label).otherwise(chain)
    return chain


def dashboard_recency_band(column: str = "Recency") -> Column:
    """Bands (0,30], (30,60], … (180,9999]; 0 and anything beyond belong to none."""
    value = F.col(column)
    return F.when(value > 0, upper_bands(value, DASHBOARD_RECENCY))


def notebook_recency_bands(longest: int | None) -> list[tuple[int, int, str]]:
    """(above, up to, label) for a table whose largest recency is `longest`; the first band includes 0.

    A band ends after each fixed number of days and one day past the largest recency; the last two numbers count
    only if recency gets that far. A label names the first and the last day. Without a recency there is no band.
    """
    if longest is None:
        return []
    end = longest + 1
    days = sorted({d for d in RECENCY_DAYS if d <= max(end, RECENCY_DAYS[2])} | {end})
    bands, above = [], 0
    for day in days:
        first = 0 if (above, day) == (0, RECENCY_DAYS[0]) else above + 1
        bands.append((above, day, f">{above}" if above == RECENCY_DAYS[-1] else f"{first}–{day}"))
        above = day
    return bands


def notebook_recency_band(longest: int | None, column: str = "Recency") -> Column:
    bands = [(b, label) for _, b, label in notebook_recency_bands(longest)]
    return F.when(F.col(column) >= 0, upper_bands(F.col(column), bands)).cast("string")


def frequency_band(column: str = "Frequency") -> Column:
    value = F.col(column)
    return F.when(value > 0, upper_bands(value, FREQUENCY_BANDS, FREQUENCY_OPEN))


def bin_number(column: str | Column, edges: Sequence[float]) -> Column:
    """1-based right-closed bin between the first and last edge; null outside. The lowest edge is included."""
    value = F.col(column) if isinstance(column, str) else column
    chain = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        chain = F.when(value <= F.lit(edges[i]), i).otherwise(chain)
    return F.when(value >= F.lit(edges[0]), chain).cast("int")


def equal_width_bin(column: str | Column, low: float, high: float, bins: int) -> Column:
    """0-based bin of equal width; the top edge joins the last bin."""
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    if high == low:
        low, high = low - 0.5, high + 0.5
    width = F.lit(float(high - low))
    return F.least(F.floor((value - F.lit(float(low))) * bins / width), F.lit(bins - 1)).cast("int")
