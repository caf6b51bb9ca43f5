"""Dates, minima and fixed names. Windows are parameters and are never derived from data."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Windows:
    """Observation up to and including `snapshot`; labels from the days after it, both ends inclusive."""

    snapshot: date
    future_start: date
    future_end: date
    min_invoices: int = 2
    min_span_days: int = 30

    def __post_init__(self):
        if not self.snapshot < self.future_start <= self.future_end:
            raise ValueError(
                f"the label window {self.future_start}..{self.future_end} must follow the snapshot {self.snapshot}"
            )


# The study dates of the original retail data.
RETAIL = Windows(date(2011, 8, 31), date(2011, 9, 1), date(2011, 11, 29))

# Column names of the interchange tables.
EXPECTED_COLUMNS = [
    "InvoiceNo",
    "StockCode",
    "Description",
    "Quantity",
    "InvoiceDate",
    "UnitPrice",
    "CustomerID",
    "Country",
]
QUALIFIED_COLUMNS = EXPECTED_COLUMNS + ["Revenue", "IsCancellation"]
PREDICTORS = [
    "Recency",
    "Frequency",
    "Monetary",
    "AvgOrderValue",
    "UniqueProducts",
    "TotalItems",
    "ActiveMonths",
    "TenureDays",
    "PurchaseSpanDays",
]
FEATURE_COLUMNS = ["CustomerID"] + PREDICTORS + ["Country", "R", "F", "M", "RFM_Score", "RFM_Segment", "Churn_90D"]
LABEL = "Churn_90D"

# Category names in reporting order.
SEGMENTS = ["Very High Value", "High Value", "Medium Value", "Lower Value"]
TIERS = ["High Risk", "Medium Risk", "Low Risk"]

# Names that would reveal the label window, and names that may not be predictors.
FUTURE_COLUMNS = [
    "FutureOrderCount",
    "FutureRevenue",
    "FutureRecency",
    "FutureFrequency",
    "FutureProducts",
    "future_purchase_count",
]
NON_PREDICTORS = ["CustomerID", "Churn_90D", "R", "F", "M", "RFM_Score", "RFM_Segment"]

# Decision thresholds of the threshold table.
THRESHOLDS = [0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60]
DECISION_THRESHOLD = 0.50
TEST_SHARE = 0.2
SEED = 42
