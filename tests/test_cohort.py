from datetime import date

import pytest

from cohortspark.config import RETAIL, Windows
from cohortspark.operators import cohort


def ids(df):
    return sorted(r["CustomerID"] for r in df.collect())


def purchase(customer, invoice, when):
    return {"CustomerID": customer, "InvoiceNo": invoice, "InvoiceDate": when}


def test_windows_must_not_overlap():
    with pytest.raises(ValueError):
        Windows(date(2011, 8, 31), date(2011, 8, 31), date(2011, 11, 29))
    assert (RETAIL.future_end - RETAIL.future_start).days + 1 == 90


def test_eligibility_minima(lines):
    df = lines(
        purchase(1, "a", "2011-01-01"),
        purchase(1, "b", "2011-02-10"),
        purchase(2, "c", "2011-01-01"),
        purchase(3, "d", "2011-01-01"),
        purchase(3, "e", "2011-01-15"),
        purchase(4, "f", "2011-01-01"),
        purchase(4, "f", "2011-03-15"),
    )
    assert ids(cohort.eligible_customers(df, RETAIL)) == [1]


def test_span_counts_elapsed_days_not_calendar_days(lines):
    df = lines(
        purchase(1, "a", "2011-01-02T23:00:00"),
        purchase(1, "b", "2011-02-01T01:00:00"),
        purchase(2, "c", "2011-01-02T23:00:00"),
        purchase(2, "d", "2011-02-01T23:00:00"),
    )
    assert ids(cohort.eligible_customers(df, RETAIL)) == [2]


def test_time_zone_of_the_session_does_not_matter(spark, lines):
    """30 days to the second across a clock change, and a time that the zone skips."""
    df = lines(
        purchase(1, "a", "2011-03-01T12:00:00"),
        purchase(1, "b", "2011-03-31T12:00:00"),
        purchase(2, "c", "2011-03-13T02:30:00"),
        purchase(2, "d", "2011-04-12T02:30:00"),
        purchase(3, "e", "2011-03-13T02:30:00"),
        purchase(3, "f", "2011-04-12T02:29:59"),
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert ids(cohort.eligible_customers(df, RETAIL)) == [1, 2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_only_the_observation_window_counts(lines):
    df = lines(purchase(1, "a", "2011-08-20"), purchase(1, "b", "2011-10-20"))
    assert ids(cohort.eligible_customers(df, RETAIL)) == []


def test_whole_snapshot_day_is_observed(lines):
    df = lines(
        purchase(1, "a", "2011-08-30T12:00:00"),
        purchase(2, "b", "2011-08-31T00:00:00"),
        purchase(3, "c", "2011-08-31T23:59:59"),
        purchase(4, "d", "2011-09-01T00:00:00"),
    )
    assert ids(cohort.observation_lines(df, RETAIL)) == [1, 2, 3]


def test_lines_of_eligible_include_later_ones(lines):
    df = lines(
        purchase(1, "a", "2011-01-01"), purchase(1, "b", "2011-03-01"), purchase(1, "c", "2011-12-05"), purchase(2, "d", "2011-01-01")
    )
    for table in (df, cohort.with_slice(df)):
        kept = cohort.lines_of_eligible(table, RETAIL)
        assert kept.columns == df.columns
        assert sorted(r["InvoiceNo"] for r in kept.collect()) == ["a", "b", "c"]


def test_heavy_customer_is_divided(spark, lines):
    """Customer 1 has most lines; their join keys are many, and every line is kept once, repeats included."""
    rows = [purchase(1, f"a{i}", f"2011-0{1 + i % 8}-01") for i in range(500)]
    df = lines(*rows, *rows, *[purchase(c, f"{c}{d}", d) for c in range(2, 40) for d in ("2011-01-01", "2011-03-01")])
    assert cohort.lines_of_eligible(df, RETAIL).count() == 1000 + 2 * 38
    assert cohort.with_slice(df).filter("CustomerID = 1").select(cohort.SLICE).distinct().count() > 300


def test_lines_without_customer_invoice_or_date(lines):
    """Lines without a customer go; without an invoice or a date they belong to their customer but count for nothing."""
    whole = [purchase(1, "a", "2011-01-01"), purchase(1, "b", "2011-03-01")]
    odd = [purchase(None, "a", "2011-01-01"), purchase(1, None, "2011-04-01"), purchase(1, "c", None), purchase(2, None, None)]
    kept = cohort.lines_of_eligible(lines(*whole, *odd), RETAIL).collect()
    assert sorted(str(r["InvoiceNo"]) for r in kept) == ["None", "a", "b", "c"]
    assert cohort.lines_of_eligible(lines(), RETAIL).count() == 0


@pytest.mark.parametrize(
    "when, label",
    [
        ("2011-08-31T23:59:59", 1),
        ("2011-09-01", 0),
        ("2011-09-15", 0),
        ("2011-11-29T23:59:59", 0),
        ("2011-11-30", 1),
        (None, 1),
    ],
)
def test_label_boundaries(spark, lines, when, label):
    rows = [purchase(1, "a", "2011-01-01"), purchase(999, "z", "2011-09-10")]
    df = lines(*rows, *([purchase(1, "b", when)] if when else []))
    customers = spark.createDataFrame([(1,)], "CustomerID bigint")
    assert [tuple(r) for r in cohort.inactivity_label(df, customers, RETAIL).collect()] == [(1, label)]
