from datetime import date

import pytest

from cohortspark.config import FEATURE_COLUMNS, FUTURE_COLUMNS, RETAIL
from cohortspark.operators import checks, features


def observed(lines, *more):
    rows = [
        (100, "A1", "X1", 2, 10.0, "2011-01-15", "United Kingdom"),
        (100, "A2", "X2", 1, 5.0, "2011-04-10", "United Kingdom"),
        (100, "A3", "X1", 3, 10.0, "2011-07-01", "United Kingdom"),
        (200, "B1", "Y1", 5, 4.0, "2011-02-01", "Germany"),
        (200, "B2", "Y2", 2, 8.0, "2011-06-01", "Germany"),
        *more,
    ]
    names = ["CustomerID", "InvoiceNo", "StockCode", "Quantity", "UnitPrice", "InvoiceDate", "Country"]
    return lines(*[dict(zip(names, r)) for r in rows])


def test_values(lines):
    table = {r["CustomerID"]: r.asDict() for r in features.customer_features(observed(lines), RETAIL).collect()}
    assert table[100] == {
        "CustomerID": 100,
        "Recency": 61,
        "Frequency": 3,
        "Monetary": 55.0,
        "AvgOrderValue": 55 / 3,
        "UniqueProducts": 2,
        "TotalItems": 6,
        "ActiveMonths": 3,
        "TenureDays": 228,
        "PurchaseSpanDays": 167,
        "Country": "United Kingdom",
    }
    assert (table[200]["Frequency"], table[200]["Monetary"], table[200]["Country"]) == (2, 36.0, "Germany")


def test_lines_after_the_snapshot_do_not_count(lines):
    later = (100, "A9", "X9", 50, 99.0, "2011-09-01", "France")
    assert features.customer_features(observed(lines, later), RETAIL).exceptAll(
        features.customer_features(observed(lines), RETAIL)
    ).isEmpty()


def test_intraday_times_do_not_shift_days(lines):
    df = lines(
        {"CustomerID": 1, "InvoiceDate": "2011-08-31T23:59:59", "InvoiceNo": "a"},
        {"CustomerID": 1, "InvoiceDate": "2011-08-01T23:00:00", "InvoiceNo": "b"},
    )
    row = features.behaviour(df, RETAIL).first()
    assert (row["Recency"], row["TenureDays"], row["PurchaseSpanDays"]) == (0, 30, 30)


def test_recency_and_span_add_up_to_tenure(lines):
    rows = features.behaviour(observed(lines), RETAIL).collect()
    assert all(r["Recency"] + r["PurchaseSpanDays"] == r["TenureDays"] for r in rows)


def test_missing_invoice_numbers_are_not_distinct_values(lines):
    df = lines(
        {"CustomerID": 1, "InvoiceNo": None, "InvoiceDate": "2011-01-01"},
        {"CustomerID": 1, "InvoiceNo": "a", "InvoiceDate": "2011-01-01"},
    )
    assert features.behaviour(df, RETAIL).first()["Frequency"] == 1


def country_of(lines, *rows):
    df = lines(*[{"CustomerID": 1, "Country": c, "InvoiceDate": d, "InvoiceNo": i} for i, (c, d) in enumerate_text(rows)])
    return features.main_country(df).first()["Country"]


def enumerate_text(rows):
    return [(str(i), r) for i, r in enumerate(rows)]


def test_country_majority(lines):
    assert country_of(lines, ("A", "2011-01-01"), ("A", "2011-01-02"), ("B", "2011-05-01")) == "A"


def test_country_tie_goes_to_the_later_purchase(lines):
    assert country_of(lines, ("A", "2011-01-01"), ("B", "2011-05-01")) == "B"


def test_country_tie_on_time_goes_to_the_alphabet(lines):
    assert country_of(lines, ("B", "2011-01-01"), ("A", "2011-01-01")) == "A"


def test_missing_country_is_ignored(lines):
    assert country_of(lines, (None, "2011-05-01"), (None, "2011-05-02"), ("A", "2011-01-01")) == "A"


def test_labelled_features_equal_the_separate_operators(lines):
    from cohortspark.operators import cohort

    df = observed(
        lines,
        (100, "A9", "X9", 1, 9.0, "2011-10-01", "France"),
        (300, "C1", "X1", 1, 9.0, "2011-01-01", "Spain"),
        (400, "D1", "X1", 1, 9.0, "2011-10-01", "Spain"),
    )
    whole = features.labelled_features(df, RETAIL)
    eligible = cohort.eligible_customers(df, RETAIL)
    parts = features.attach_label(
        features.customer_features(df, RETAIL).join(eligible, "CustomerID", "left_semi"),
        cohort.inactivity_label(df, eligible, RETAIL),
    ).select(whole.columns)
    assert whole.exceptAll(parts).isEmpty() and parts.exceptAll(whole).isEmpty()
    assert {r["CustomerID"]: r["Churn_90D"] for r in whole.collect()} == {100: 0, 200: 1}


def ten_customers(lines):
    """Customer c has c + 1 invoices, 30 days apart."""
    rows = []
    for c in range(1, 11):
        for i in range(c + 1):
            day = date.fromordinal(date(2010, 8, 1).toordinal() + 30 * i)
            rows.append({"CustomerID": c, "InvoiceNo": f"{c}-{i}", "InvoiceDate": day.isoformat(), "Quantity": c})
    return lines(*rows)


def test_customer_table_shape(lines):
    table = features.customer_table(features.labelled_features(ten_customers(lines), RETAIL))
    assert table.columns == FEATURE_COLUMNS
    rows = table.collect()
    assert len(rows) == 10
    assert all(3 <= r["RFM_Score"] <= 15 and r["RFM_Score"] == r["R"] + r["F"] + r["M"] for r in rows)
    best = {r["CustomerID"]: r for r in rows}
    assert (best[10]["R"], best[10]["F"], best[10]["M"]) == (5, 5, 5)
    assert (best[1]["R"], best[1]["F"], best[1]["M"]) == (1, 1, 1)


def test_table_passes_its_checks(lines):
    table = features.customer_table(features.labelled_features(ten_customers(lines), RETAIL))
    checks.require(checks.label_violations(table))
    checks.require_no_future_columns(table.columns)
    assert not set(FUTURE_COLUMNS) & set(table.columns)


@pytest.mark.parametrize("missing", [True, False])
def test_missing_label_is_a_violation(spark, missing):
    table = spark.createDataFrame([(1, None if missing else 2), (1, 1)], "CustomerID bigint, Churn_90D int")
    row = checks.label_violations(table).first().asDict()
    assert row == {
        "missing_labels": int(missing),
        "non_binary_labels": int(not missing),
        "repeated_customers": 1,
    }
    with pytest.raises(ValueError):
        checks.require(checks.label_violations(table))
