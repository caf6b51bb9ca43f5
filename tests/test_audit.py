from sample import at

from cohortspark.operators import audit
from cohortspark.operators.cleaning import clean


def blemished(raw_lines):
    return raw_lines(
        {},
        {},
        {"CustomerID": None, "Description": None},
        {"InvoiceNo": "C1", "Quantity": -2, "Country": "France"},
        {"Quantity": 0, "UnitPrice": 0.0},
        {"UnitPrice": -1.0, "InvoiceDate": None},
        {"InvoiceNo": "A2", "StockCode": "S2", "InvoiceDate": at("2011-02-03T23:59:59"), "CustomerID": 5},
    )


def test_every_measure(raw_lines):
    assert audit.audit(blemished(raw_lines)).first().asDict() == {
        "raw_rows": 7,
        "raw_columns": 8,
        "missing_customer_id": 1,
        "missing_description": 1,
        "exact_duplicates": 1,
        "cancellation_rows": 1,
        "negative_quantity_rows": 1,
        "zero_quantity_rows": 1,
        "non_positive_quantity_rows": 2,
        "negative_unit_price_rows": 1,
        "zero_unit_price_rows": 1,
        "non_positive_unit_price_rows": 2,
        "date_parse_failures": 1,
        "date_min": "2011-01-10",
        "date_max": "2011-02-03",
        "unique_invoices": 3,
        "unique_products": 2,
        "unique_customers": 2,
        "country_count": 2,
    }


def test_all_dates_missing(raw_lines):
    row = audit.audit(raw_lines({"InvoiceDate": None})).first()
    assert (row["date_min"], row["date_max"], row["date_parse_failures"]) == (None, None, 1)


def test_empty_input(raw_lines):
    row = audit.audit(raw_lines({}).limit(0)).first()
    assert row["raw_rows"] == 0 and row["exact_duplicates"] == 0 and row["unique_customers"] == 0


def test_extra_columns_count_and_take_part_in_duplicates(raw_lines):
    from pyspark.sql import functions as F

    df = raw_lines({}, {}).withColumn("line", F.monotonically_increasing_id())
    row = audit.audit(df).first()
    assert row["raw_columns"] == 9 and row["exact_duplicates"] == 0 and row["unique_invoices"] == 1


def test_old_names_resolve(raw_lines):
    row = audit.with_aliases(audit.audit(blemished(raw_lines))).first()
    for old, new in audit.AUDIT_ALIASES.items():
        assert row[old] == row[new]


def test_file_has_twenty_measures(raw_lines):
    raw = blemished(raw_lines)
    row = audit.audit_report(raw, clean(raw)).first().asDict()
    assert list(row) == [*audit.AUDIT_FILE, "qualified_rows", "qualified_customers"]
    assert (row["duplicate_rows"], row["qualified_rows"], row["qualified_customers"]) == (1, 2, 2)


def test_missing_values_lists_only_columns_with_gaps(raw_lines):
    rows = {r["column"]: (r["missing_count"], r["missing_pct"]) for r in audit.missing_values(blemished(raw_lines)).collect()}
    assert rows == {"CustomerID": (1, 14.29), "Description": (1, 14.29), "InvoiceDate": (1, 14.29)}


def test_stage_counts(raw_lines):
    row = audit.stage_counts(blemished(raw_lines)).first().asDict()
    assert row == {
        "raw_rows": 7,
        "deduplicated_rows": 6,
        "duplicates_removed": 1,
        "qualified_rows": 2,
        "removed_by_cleaning": 4,
    }


def test_sign_profile(raw_lines):
    rows = {r["column"]: tuple(r)[1:] for r in audit.sign_profile(blemished(raw_lines)).collect()}
    assert rows == {"Quantity": (1, 1, 5), "UnitPrice": (1, 1, 5)}


def test_describe_matches_linear_quartiles(values):
    df = values("x", [1.0, 2.0, 4.0, 8.0, None])
    row = audit.describe(df, ["x"]).first()
    assert (row["count"], row["q25"], row["q50"], row["q75"], row["max"]) == (4, 1.75, 3.0, 5.0, 8.0)
    assert abs(row["std"] - 3.095696) < 1e-6


def test_top_countries_break_ties_by_name(raw_lines):
    df = raw_lines({"Country": "B"}, {"Country": "A"}, {"Country": "C"}, {"Country": "C"}, {"Country": None})
    assert [r["Country"] for r in audit.top_countries(df, 2).collect()] == ["C", "A"]
