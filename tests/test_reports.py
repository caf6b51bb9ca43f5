import numpy as np
import pytest

from cohortspark.config import RETAIL
from cohortspark.plans import reports


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        r, f, m = (int(x) for x in rng.integers(1, 6, 3))
        score = r + f + m
        name = "Very High Value" if score >= 13 else "High Value" if score >= 10 else "Medium Value"
        rows.append((i, int(rng.integers(0, 237)), int(rng.integers(2, 30)), round(float(rng.lognormal(6, 1)), 2), score, name, int(rng.random() < 0.3)))
    schema = "CustomerID bigint, Recency int, Frequency bigint, Monetary double, RFM_Score int, RFM_Segment string, Churn_90D int"
    return spark.createDataFrame(rows, schema)


def test_histogram_equals_numpy(table):
    data = table.toPandas()
    for column, cap in (("Recency", None), ("Frequency", 20), ("Monetary", 1000)):
        x = data[column].clip(upper=cap) if cap else data[column]
        want, edges = np.histogram(x, bins=40)
        rows = sorted(reports.histogram(table, column, 40, cap).collect())
        assert [r["customers"] for r in rows] == want.tolist()
        assert np.allclose([r["lower"] for r in rows], edges[:-1], atol=1e-6)


def test_histogram_of_one_value(values):
    rows = reports.histogram(values("x", [3.0, 3.0]), "x", 4).collect()
    assert sum(r["customers"] for r in rows) == 2 and len(rows) == 4


def test_histogram_of_no_rows(table):
    rows = reports.histogram(table.limit(0), "Monetary", 3).collect()
    assert [r["customers"] for r in rows] == [0, 0, 0]


def test_absent_segment_is_kept_with_zero(table):
    rows = {r["RFM_Segment"]: r for r in reports.segment_distribution(table).collect()}
    assert rows["Lower Value"]["customers"] == 0 and sum(r["customers"] for r in rows.values()) == 200
    assert "Lower Value" not in [r["RFM_Segment"] for r in reports.segment_distribution(table, keep_empty=False).collect()]
    revenue = {r["RFM_Segment"]: r for r in reports.segment_revenue(table).collect()}
    assert revenue["Lower Value"]["total_revenue"] is None and revenue["Lower Value"]["customers"] == 0
    inactive = {r["RFM_Segment"]: r for r in reports.segment_inactivity(table).collect()}
    assert inactive["Lower Value"]["inactivity_rate_pct"] is None


def test_box_statistics(table):
    data = table.toPandas()
    rows = {(r["column"], r["Churn_90D"]): r for r in reports.box_statistics(table, {"Monetary": 900}).collect()}
    for label in (0, 1):
        x = data.loc[data.Churn_90D == label, "Monetary"].clip(upper=900)
        q1, q2, q3 = np.percentile(x, [25, 50, 75])
        low, high = x[x >= q1 - 1.5 * (q3 - q1)].min(), x[x <= q3 + 1.5 * (q3 - q1)].max()
        row = rows[("Monetary", label)]
        got = [row[c] for c in ("whisker_low", "q1", "median", "q3", "whisker_high")]
        assert np.allclose(got, [low, q1, q2, q3, high], atol=1e-4)


def test_correlations_are_symmetric(table):
    rows = {(r["column_a"], r["column_b"]): r["correlation"] for r in reports.correlations(table).collect()}
    assert len(rows) == 9 and rows[("Recency", "Recency")] == 1.0
    assert rows[("Recency", "Monetary")] == rows[("Monetary", "Recency")]
    want = table.toPandas()[["Recency", "Monetary"]].corr().iloc[0, 1]
    assert abs(rows[("Recency", "Monetary")] - want) < 6e-4


def test_extreme_bands_take_the_first_of_ties(spark):
    rows = [(1, 10, 2, 5.0, 3, "Lower Value", 1), (2, 40, 5, 5.0, 10, "High Value", 1), (3, 100, 8, 1.0, 10, "High Value", 0)]
    table = spark.createDataFrame(rows, "CustomerID bigint, Recency int, Frequency bigint, Monetary double, RFM_Score int, RFM_Segment string, Churn_90D int")
    row = reports.extreme_bands(table).first()
    assert (row["worst_recency"], row["best_recency"], row["worst_frequency"], row["top_segment"]) == ("0–30", "91–101", "2–3", "High Value")


def test_no_label_in_a_band_is_not_listed(table):
    rows = reports.recency_band_rates(table.filter("Recency <= 30 OR Recency > 180")).collect()
    assert [r["RecencyBand"] for r in rows][0] == "0–30" and all(r["total"] > 0 for r in rows)


def test_trends_stop_at_the_snapshot(lines):
    df = lines(
        {"InvoiceDate": "2011-08-31T23:59:59", "Revenue": 10.0, "Country": "A"},
        {"InvoiceDate": "2011-08-01", "Revenue": 0.1, "Country": "B"},
        {"InvoiceDate": "2011-09-01", "Revenue": 99.0, "Country": "C"},
    )
    assert [(str(r["month"]), r["revenue"]) for r in reports.monthly_revenue(df, RETAIL).collect()] == [("2011-08-01", 10.1)]
    assert [r["Country"] for r in reports.country_revenue(df, RETAIL).collect()] == ["A", "B"]


def test_summary_has_all_parts(spark, lines):
    from test_features import ten_customers

    from cohortspark.operators import features

    df = ten_customers(lines)
    table = features.customer_table(features.labelled_features(df, RETAIL))
    row = reports.summary_report(table, df, RETAIL).first().asDict(recursive=True)
    assert row["snapshot_date"] == row["observation_end"] == "2011-08-31"
    assert row["eligible_customers"] == 10 and row["churn_90d"]["class_1_count"] == 10
    assert sum(row["rfm_segment_counts"].values()) == 10 and sum(row["rfm_score_distribution"].values()) == 10
    assert set(row["rfm_feature_summary"]) == set(reports.SUMMARY_COLUMNS)
    assert row["rfm_feature_summary"]["Frequency"] == {"min": 2.0, "max": 11.0, "mean": 6.5, "median": 6.5}


def test_tables_without_customers(spark):
    from cohortspark.functions import bands
    from cohortspark.plans import reports
    from cohortspark.schemas import FEATURES

    empty = spark.createDataFrame([], FEATURES)
    assert reports.recency_band_rates(empty).count() == 0
    assert empty.select(bands.notebook_recency_band(None).alias("b")).count() == 0
    assert bands.notebook_recency_bands(None) == []
    reports.extreme_bands(empty).collect()
