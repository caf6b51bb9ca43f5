import pytest

from cohortspark.plans import explorer


@pytest.fixture
def risk(spark):
    schema = """CustomerID bigint, Country string, Recency int, Frequency bigint, Monetary double, AvgOrderValue double,
        UniqueProducts bigint, TotalItems bigint, ActiveMonths bigint, TenureDays int, PurchaseSpanDays int, R int, F int,
        M int, RFM_Score int, RFM_Segment string, Churn_Probability double, Risk_Tier string, Retention_Priority string"""
    rows = [
        (100, "France", 5, 3, 1234.5, 411.5, 7, 90, 2, 80, 75, 5, 3, 4, 12, "High Value", 12.35, "Low Risk", "Relationship / loyalty attention"),
        (200, "Spain", 50, 2, 99.5, 49.75, 3, 9, 2, 99, 49, 1, 1, 1, 3, "Lower Value", 88.0, "High Risk", "Lower-cost intervention"),
        (300, None, 20, 4, 500.0, 125.0, 3, 9, 3, 60, 40, 3, 4, 3, 10, "High Value", 50.0, "Medium Risk", "Monitor / targeted engagement"),
    ]
    return spark.createDataFrame(rows, schema)


def ids(df):
    return sorted(r["CustomerID"] for r in df.collect())


@pytest.mark.parametrize(
    "text, found",
    [(" 100 ", [100]), ("100.0", [100]), (100, [100]), (100.0, [100]), ("1e2", [100]), ("", []), ("x", []), (None, []), (99999999, []), ("100.5", []), ("nan", [])],
)
def test_lookup(risk, text, found):
    got = explorer.lookup(risk, text)
    assert ids(got) == found and got.columns == risk.columns


def test_empty_choices_do_not_filter(risk):
    assert ids(explorer.directory_filter(risk)) == [100, 200, 300]
    assert ids(explorer.directory_filter(risk, ["France", "Spain"], ["High Risk"])) == [200]
    assert ids(explorer.directory_filter(risk, segments=["High Value"])) == [100, 300]


def test_ranges_include_their_ends(risk):
    assert ids(explorer.cohort_filter(risk, (5, 20))) == [100, 300]
    assert ids(explorer.cohort_filter(risk, (0, 99), (99.5, 500.0))) == [200, 300]
    assert ids(explorer.cohort_filter(risk, (0, 99), (99.5, 500.0), ["Spain"])) == [200]


def test_options(risk):
    assert [r[0] for r in explorer.country_options(risk).collect()] == ["France", "Spain"]
    assert [tuple(r) for r in explorer.segment_options(risk).collect()] == [("High Value", 2), ("Lower Value", 4)]
    assert explorer.range_options(risk).first().asDict() == {
        "min_recency": 5,
        "max_recency": 50,
        "min_monetary": 99.5,
        "max_monetary": 1234.5,
    }


def test_directory_text(risk):
    row = explorer.directory(risk).filter("CustomerID = 100").first()
    assert (row["Monetary"], row["AvgOrderValue"], row["Churn_Probability"]) == ("£1,234", "£411.50", "12.3%")
    assert explorer.directory(risk).columns == ["CustomerID", *explorer.DIRECTORY_COLUMNS]
    assert "Risk_Tier" not in explorer.directory(risk.drop("Risk_Tier")).columns


def test_profile_fills_gaps(risk):
    row = explorer.profile(explorer.lookup(risk, 300)).first()
    assert (row["Country"], row["Quintiles"], row["Recency"], row["Monetary"]) == ("—", "3/4/3", "20d", "£500")


def test_kpis(risk):
    assert explorer.cohort_kpis(risk).first().asDict() == {
        "customers": 3,
        "revenue": 1834.0,
        "mean_order_value": 195.4167,
        "mean_recency": 25.0,
    }
    assert tuple(explorer.tier_counts(risk).first()) == (3, 1, 1, 1)


def test_preview_follows_its_order(risk):
    assert [r["CustomerID"] for r in explorer.preview(risk, 2, "Recency").collect()] == [100, 300]


def test_lookup_of_large_ids(spark):
    from cohortspark.plans import explorer

    risk = spark.createDataFrame([(2**53,), (2**53 + 1,)], "CustomerID bigint")
    for asked in (2**53 + 1, str(2**53 + 1), f" {2**53 + 1}.0 "):
        assert [r["CustomerID"] for r in explorer.lookup(risk, asked).collect()] == [2**53 + 1]
    assert explorer.lookup(risk, 2**70).count() == 0
