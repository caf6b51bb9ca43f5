"""SQL for every registered query that SQL can express."""

from __future__ import annotations

from oracle.sql import (
    AUDIT,
    DASHBOARD_RECENCY,
    DIRECTORY,
    EARLY,
    EVENTS,
    FREQUENCY_GROUP,
    FREQUENCY_RATES,
    METRICS,
    PREDICTORS,
    QUALIFIES,
    RECENCY_RATES,
    SEGMENT_REVENUE,
    SEGMENTS,
    TABLE_COLUMNS,
    THRESHOLDS,
    TIERS,
    VALUE_GROUP,
    box,
    counts,
    describe,
    even,
    group_rates,
    histogram,
    share,
    summary,
    text_percent,
    text_pounds,
    values,
    with_steps,
    zero,
)
from oracle import newton

newton.register()

AUDIT_FILE = """raw_rows, CAST(raw_columns AS BIGINT) AS raw_columns, exact_duplicates AS duplicate_rows, missing_customer_id,
    missing_description, cancellation_rows, non_positive_quantity_rows, non_positive_unit_price_rows,
    negative_quantity_rows, zero_quantity_rows, negative_unit_price_rows, zero_unit_price_rows, date_min, date_max,
    unique_invoices, unique_products, unique_customers, country_count"""
RECENCY_ORDER = ["≤30d", "31–60d", "61–90d", "91–120d", "121–180d", ">180d"]
FREQUENCY_ORDER = ["Q1 (Lowest)", "Q2", "Q3", "Q4 (Highest)"]
VALUE_ORDER = ["Bottom 25%", "25–50%", "50–75%", "Top 25%"]
MONEY = "CAST(sum(CAST({} AS DECIMAL(20, 4))) AS DOUBLE)"
SPLIT_COLUMNS = f"CustomerID, {', '.join(PREDICTORS)}, Churn_90D, is_test"


def all_sql() -> dict[str, str]:
    w = with_steps
    sql = {}

    # sources and sinks
    sql["s1_raw_lines"] = w(["tx"], "SELECT * FROM tx")
    sql["s1_quoted_line_breaks"] = w(
        ["tx"],
        """SELECT * REPLACE (CASE WHEN StockCode LIKE '%7' THEN Description || chr(10) || '"second", line' || chr(10) || StockCode
                             ELSE Description END AS Description) FROM tx""",
    )
    present = " UNION ALL ".join(
        f"SELECT '{what}' AS what, true AS there, count(*) AS rows, CAST(NULL AS VARCHAR) AS error FROM {source}"
        for what, source in (("raw", "tx"), ("qualified", "ql"), ("features", "ct"), ("weights", "range(10)"))
    )
    absent = values([(what, "FileNotFoundError") for what in ("raw", "qualified", "features", "weights", "model")])
    sql["s2_missing_inputs"] = w(
        ["tx", "ql", "ct"], f"{present} UNION ALL SELECT what, false, NULL, error FROM {absent} AS t(what, error)"
    )
    sql["s4_lenient_dates"] = w(
        ["tx"],
        """SELECT InvoiceNo, StockCode, Quantity, CASE WHEN Description IS NOT NULL THEN InvoiceDate END AS InvoiceDate
           FROM tx""",
    )
    sql["s5_s6_qualified_roundtrip"] = w(["ql"], "SELECT * FROM ql")
    sql["s7_audit_file"] = w(
        ["tx", "ql"],
        f"""SELECT {AUDIT_FILE}, (SELECT count(*) FROM ql) AS qualified_rows,
            (SELECT count(DISTINCT CustomerID) FROM ql) AS qualified_customers FROM ({AUDIT}) AS a""",
    )
    sql["s8_s16_features_roundtrip"] = w(["ct"], f"SELECT {TABLE_COLUMNS} FROM ct")
    sql["s9_summary_file"] = w(["ct", "obs", "fut"], summary())
    sql["s14_trend_lines"] = w(["obs"], "SELECT InvoiceDate, CustomerID, Country, Revenue FROM obs")

    # audit
    sql["a1_audit"] = w(["tx"], AUDIT)
    sql["a2_duplicates"] = w(
        ["tx"],
        f"""SELECT n - d AS duplicate_rows, {share("n - d", "n", 3)} AS duplicate_pct
            FROM (SELECT (SELECT count(*) FROM tx) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM tx) AS t) AS d) AS c""",
    )
    sql["a3_audit_aliases"] = w(
        ["tx"],
        f"""SELECT raw_rows AS total_rows, cancellation_rows AS cancellation_invoices,
            non_positive_quantity_rows AS non_positive_quantity,
            non_positive_unit_price_rows AS non_positive_unit_price FROM ({AUDIT}) AS a""",
    )
    raw = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"]
    sql["a4_missing_values"] = w(
        ["tx"],
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS missing_count,
            {share(f"count(*) FILTER ({c} IS NULL)", "count(*)", 2)} AS missing_pct FROM tx"""
            for c in raw
        )
        + ") AS t WHERE missing_count > 0",
    )
    kinds = ["string"] * 3 + ["int", "timestamp_ntz", "double", "bigint", "string"]
    places = values([(i + 1, c, k) for i, (c, k) in enumerate(zip(raw, kinds))])
    sql["a5_column_types"] = w(
        ["tx"],
        f"""SELECT (SELECT count(*) FROM tx) AS "rows", position, "column", type FROM {places} AS t(position, "column", type)""",
    )
    sql["a6_cancellation_share"] = w(
        ["tx"],
        f"""SELECT count(*) FILTER (InvoiceNo LIKE 'C%') AS cancellation_rows,
            {share("count(*) FILTER (InvoiceNo LIKE 'C%')", "count(*)", 2)} AS cancellation_pct FROM tx""",
    )
    top = 'SELECT Country, count(*) AS "rows" FROM {} GROUP BY Country ORDER BY "rows" DESC, Country LIMIT 5'
    sql["a6_cancelled_countries"] = w(["tx"], top.format("(SELECT * FROM tx WHERE InvoiceNo LIKE 'C%') AS t"))
    sql["a7_sign_profile"] = w(
        ["tx"],
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < 0) AS negative, count(*) FILTER ({c} = 0) AS zero,
            count(*) FILTER ({c} > 0) AS positive FROM tx"""
            for c in ("Quantity", "UnitPrice")
        ),
    )
    sql["a8_describe_raw"] = w(["tx"], describe(["Quantity", "UnitPrice"], "tx"))
    sql["a8_describe_qualified"] = w(["ql"], describe(["Quantity", "UnitPrice", "Revenue"], "ql"))
    sql["a8_describe_features"] = w(["ct"], describe(PREDICTORS, "ct"))
    sql["a9_top_countries"] = w(["tx"], top.format("tx"))
    sql["a10_stage_counts"] = w(
        ["tx", "dd", "ql"],
        """SELECT r AS raw_rows, d AS deduplicated_rows, r - d AS duplicates_removed, q AS qualified_rows,
                  d - q AS removed_by_cleaning
           FROM (SELECT (SELECT count(*) FROM tx) AS r, (SELECT count(*) FROM dd) AS d, (SELECT count(*) FROM ql) AS q) AS t""",
    )
    sql["a11_after_deduplication"] = w(
        ["dd"],
        """SELECT count(*) FILTER (InvoiceNo LIKE 'C%') AS cancellations,
                  count(*) FILTER (NOT coalesce(InvoiceNo LIKE 'C%', false)) AS not_cancellations,
                  count(*) FILTER (Quantity <= 0) AS non_positive_quantity,
                  count(*) FILTER (UnitPrice <= 0) AS non_positive_price,
                  count(*) FILTER (CustomerID IS NULL) AS missing_customer FROM dd""",
    )
    sql["a12_revenue_check"] = w(
        ["ql"],
        """SELECT min(Revenue) AS min_revenue, max(Revenue) AS max_revenue,
                  count(*) FILTER (Revenue < 0) AS negative_revenue FROM ql""",
    )
    sql["a13_output_check"] = w(
        ["ql"],
        """SELECT count(*) AS "rows", count(*) FILTER (CustomerID IS NULL) AS missing_customer,
                  count(*) FILTER (Quantity <= 0) AS non_positive_quantity,
                  count(*) FILTER (UnitPrice <= 0) AS non_positive_price,
                  count(*) FILTER (Revenue < 0) AS negative_revenue FROM ql""",
    )
    sql["a14_window_summary"] = w(
        ["obs", "fut"],
        " UNION ALL ".join(
            f"""SELECT '{name}' AS "window", count(*) AS "rows", CAST(min(InvoiceDate) AS DATE) AS first_day,
            CAST(max(InvoiceDate) AS DATE) AS last_day, count(DISTINCT CustomerID) AS customers FROM {source}"""
            for name, source in (("observation", "obs"), ("future", "fut"))
        ),
    )

    # cleaning and windows
    sql["c1_fill_descriptions"] = w(["filled"], "SELECT * FROM filled")
    sql["c2_drop_duplicates"] = w(["dd"], "SELECT * FROM dd")
    sql["c3_flag_cancellations"] = w(["tx"], "SELECT *, coalesce(InvoiceNo LIKE 'C%', false) AS IsCancellation FROM tx")
    sql["c4_c5_qualifying_filter"] = w(
        ["tx"], f"SELECT *, CAST(Quantity AS DOUBLE) * UnitPrice AS Revenue FROM tx WHERE {QUALIFIES}"
    )
    sql["c6_observation_window"] = w(["obs"], "SELECT * FROM obs")
    sql["c7_future_window"] = w(["fut"], "SELECT * FROM fut")
    sql["c8_directory_filter"] = w(
        ["rk"],
        """SELECT CustomerID, Country, Risk_Tier, RFM_Segment FROM rk
           WHERE Country IN ('NATION_1', 'NATION_4', 'NATION_9') AND Risk_Tier IN ('High Risk', 'Medium Risk')
             AND RFM_Segment IN ('Lower Value', 'Medium Value')""",
    )
    cohort = """(SELECT * FROM ct WHERE Recency BETWEEN 30 AND 400 AND Monetary BETWEEN 300000 AND 1500000
                 AND RFM_Segment IN ('High Value', 'Medium Value')) AS f"""
    sql["c9_cohort_filter"] = w(["ct"], f"SELECT {TABLE_COLUMNS} FROM {cohort}")
    sql["c10_country_options"] = w(["ct"], "SELECT DISTINCT Country FROM ct WHERE Country IS NOT NULL")
    sql["c10_segment_options"] = w(
        ["ct"], f"SELECT DISTINCT RFM_Segment, CAST(position AS INTEGER) AS position FROM ct JOIN {SEGMENTS} ON RFM_Segment = name"
    )
    sql["c10_range_options"] = w(
        ["ct"],
        """SELECT min(Recency) AS min_recency, max(Recency) AS max_recency, min(Monetary) AS min_monetary,
                  max(Monetary) AS max_monetary FROM ct""",
    )
    sql["c11_lookup"] = w(["ct"], f"SELECT {TABLE_COLUMNS} FROM ct WHERE CustomerID = 7")
    sql["c12_directory"] = w(["rk"], f"SELECT {DIRECTORY} FROM rk")
    sql["c13_profile"] = w(
        ["rk"],
        f"""SELECT CustomerID, Country, CAST(Recency AS VARCHAR) || 'd' AS Recency, CAST(Frequency AS VARCHAR) AS Frequency,
            {text_pounds("Monetary")} AS Monetary, {text_pounds("AvgOrderValue", 2)} AS AvgOrderValue,
            CAST(ActiveMonths AS VARCHAR) AS ActiveMonths, CAST(RFM_Score AS VARCHAR) AS RFM_Score,
            R || '/' || F || '/' || M AS Quintiles, RFM_Segment, {text_percent("Churn_Probability")} AS Churn_Probability,
            Risk_Tier, Retention_Priority FROM rk""",
    )
    sql["c14_c15_scatter"] = w(
        ["ct"],
        """SELECT CustomerID, least(CAST(Frequency AS DOUBLE), 60) AS Frequency, least(Monetary, 15000) AS Monetary, Churn_90D
           FROM ct""",
    )
    sql["c15_scatter_recency_monetary"] = w(
        ["ct"], "SELECT CustomerID, CAST(Recency AS DOUBLE) AS Recency, Monetary, RFM_Segment FROM ct"
    )
    sql["c15_scatter_recency_frequency"] = w(
        ["ct"],
        """SELECT CustomerID, CAST(Recency AS DOUBLE) AS Recency, least(CAST(Frequency AS DOUBLE), 60) AS Frequency, Churn_90D
           FROM ct""",
    )

    # joins
    sql["j1_lines_of_eligible"] = w(["ql", "elig"], "SELECT * FROM ql WHERE CustomerID IN (SELECT CustomerID FROM elig)")
    sql["j2_active_months"] = w(["beh"], "SELECT CustomerID, ActiveMonths FROM beh")
    sql["j5_attach_label"] = w(
        ["beh", "lab"], "SELECT beh.*, Churn_90D FROM beh LEFT JOIN lab USING (CustomerID)"
    )
    sql["j5_labelled_behaviour"] = sql["j5_attach_label"]
    sql["j6_model_rows"] = w(
        ["lf"], f"SELECT CustomerID, {', '.join(PREDICTORS)}, Churn_90D FROM lf WHERE Churn_90D IS NOT NULL"
    )
    sql["j7_i3_risk_table"] = w(["rk"], f"SELECT {TABLE_COLUMNS}, Churn_Probability, Risk_Tier, Retention_Priority FROM rk")
    sql["j10_split_overlap"] = w(
        ["sp"],
        """SELECT count(*) AS overlapping_customers
           FROM (SELECT CustomerID FROM sp GROUP BY CustomerID HAVING count(DISTINCT is_test) > 1) AS t""",
    )

    # windows, ranks, bands
    table = f"SELECT {TABLE_COLUMNS} FROM ct"
    scores = "SELECT CustomerID, R, F, M, RFM_Score, RFM_Segment FROM ct"
    sql["w1_w2_w3_rfm_scores"] = w(["ct"], scores)
    sql["w1_rank_rule_scores"] = w(["ct"], scores, EARLY)
    sql["w4_main_country"] = w(["ctry"], "SELECT CustomerID, Country FROM ctry")
    sql["w5_frequency_group"] = w(["ct"], f'SELECT CustomerID, grp AS "Frequency_Group" FROM ({FREQUENCY_GROUP}) AS t')
    sql["w6_global_rank"] = w(
        ["beh"],
        """SELECT CustomerID, Frequency, CAST(row_number() OVER (ORDER BY Frequency, CustomerID) AS BIGINT) AS rank FROM beh""",
    )
    sql["w6_global_rank_descending"] = w(
        ["beh"],
        """SELECT CustomerID, Recency, CAST(row_number() OVER (ORDER BY Recency DESC, CustomerID) AS BIGINT) AS rank FROM beh""",
    )
    sql["w7_dashboard_recency_band"] = w(
        ["ct"], f'SELECT CustomerID, grp AS "Recency_Band" FROM ({DASHBOARD_RECENCY}) AS t'
    )
    sql["w8_notebook_recency_band"] = w(["ct"], _band_of("Recency", "RecencyBand", RECENCY_RATES))
    sql["w9_frequency_band"] = w(
        ["ct"],
        """SELECT CustomerID, CASE WHEN Frequency <= 3 THEN '2–3' WHEN Frequency <= 6 THEN '4–6' WHEN Frequency <= 10 THEN '7–10'
                  WHEN Frequency <= 20 THEN '11–20' ELSE '>20' END AS "FreqGroup" FROM ct""",
    )
    sql["w10_value_group"] = w(["ct"], f'SELECT CustomerID, grp AS "Value_Group" FROM ({VALUE_GROUP}) AS t')

    # aggregations
    sql["g1_eligible_customers"] = w(["elig"], "SELECT CustomerID FROM elig")
    sql["g1_eligible_event_customers"] = w(["elig_ev"], "SELECT CustomerID FROM elig_ev", EVENTS)
    sql["g2_customer_features"] = w(["beh", "ctry"], "SELECT beh.*, Country FROM beh LEFT JOIN ctry USING (CustomerID)")
    sql["g3_inactivity_label"] = w(["lab"], "SELECT * FROM lab")
    sql["g4_customer_table"] = w(["ct"], table)
    sql["g4_customer_table_early"] = w(["ct"], table, EARLY)
    sql["g4_event_customer_table"] = w(["ct_ev"], f"SELECT {TABLE_COLUMNS} FROM ct_ev", EVENTS)
    sql["g5_rate_by_segment"] = w(
        ["ct"],
        """SELECT RFM_Segment, count(Churn_90D) AS n, CAST(sum(Churn_90D) AS BIGINT) AS churned,
                  CAST(sum(Churn_90D) AS DOUBLE) / count(Churn_90D) AS churn_rate FROM ct GROUP BY RFM_Segment""",
    )
    sql["g6_recency_rates"] = w(["ct"], group_rates("Recency_Band", DASHBOARD_RECENCY, RECENCY_ORDER))
    sql["g6_frequency_rates"] = w(["ct"], group_rates("Frequency_Group", FREQUENCY_GROUP, FREQUENCY_ORDER))
    sql["g6_value_rates"] = w(["ct"], group_rates("Value_Group", VALUE_GROUP, VALUE_ORDER))
    sql["g7_recency_band_rates"] = w(["ct"], RECENCY_RATES)
    sql["g7_frequency_band_rates"] = w(["ct"], FREQUENCY_RATES)
    sql["g8_segment_revenue"] = w(["ct"], SEGMENT_REVENUE)
    sql["g9_segment_inactivity"] = w(
        ["ct"],
        f"""SELECT position, name AS RFM_Segment, count(Churn_90D) AS customers,
            coalesce(CAST(sum(Churn_90D) AS BIGINT), 0) AS churned,
            count(Churn_90D) - coalesce(CAST(sum(Churn_90D) AS BIGINT), 0) AS active,
            {share("sum(Churn_90D)", "count(Churn_90D)", 1)} AS inactivity_rate_pct
            FROM {SEGMENTS} LEFT JOIN ct ON RFM_Segment = name GROUP BY 1, 2""",
    )
    sql["g10_segment_counts"] = w(["ct"], counts("ct", "RFM_Segment", SEGMENTS, True))
    sql["g10_tier_counts"] = w(["rk"], counts("rk", "Risk_Tier", TIERS, False))
    sql["g10_score_counts"] = w(
        ["ct"], counts("ct", "RFM_Score", values([(i - 2, i) for i in range(3, 16)]) + " AS o(position, name)", True)
    )
    sql["g10_class_counts"] = w(
        ["ct"],
        f"""SELECT *, CASE WHEN "Churn_90D" = 0 THEN 'Active (0)' ELSE 'Inactive (1)' END AS class_name
            FROM ({counts("ct", "Churn_90D", "(VALUES (1, 0), (2, 1)) AS o(position, name)", False)}) AS t""",
    )
    active, inactive = "count(*) FILTER (Churn_90D = 0)", "count(*) FILTER (Churn_90D = 1)"
    sql["g11_class_balance"] = w(
        ["ct"],
        f"""SELECT count(*) AS customers, {active} AS active, {inactive} AS inactive,
            {share(active, "count(*)", 2)} AS active_pct, {share(inactive, "count(*)", 2)} AS inactive_pct,
            {even(f"CAST({active} AS DOUBLE) / nullif({inactive}, 0)", 2)} AS imbalance_ratio FROM ct""",
    )
    rfm = ["Recency", "Frequency", "Monetary"]
    sql["g12_correlations"] = w(
        ["ct"],
        " UNION ALL ".join(
            f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 3) AS correlation FROM ct"
            for a in rfm
            for b in rfm
        ),
    )
    quantile_columns = rfm + ["AvgOrderValue", "TenureDays", "PurchaseSpanDays", "ActiveMonths"]
    sql["g13_quantile_table"] = w(
        ["ct"],
        " UNION ALL ".join(
            f"SELECT {p}::DOUBLE AS probability, "
            + ", ".join(f"{even(f'quantile_cont(CAST({c} AS DOUBLE), {p})', 1)} AS {c}" for c in quantile_columns)
            + " FROM ct"
            for p in (0.1, 0.25, 0.5, 0.75, 0.9)
        ),
    )
    sql["g14_box_statistics"] = w(["ct"], box())
    sql["g15_recency_histogram"] = w(["ct"], histogram("ct", "Recency", 40))
    sql["g15_frequency_histogram"] = w(["ct"], histogram("ct", "Frequency", 40, 50))
    sql["g15_monetary_histogram"] = w(["ct"], histogram("ct", "Monetary", 40, 1000000))
    sql["g16_probability_histogram"] = w(["rk"], histogram("rk", "Churn_Probability", 40))
    sql["g16_probability_by_tier"] = w(["rk"], histogram("rk", "Churn_Probability", 35, group="Risk_Tier"))
    sql["g16_filtered_recency_histogram"] = w(["ct"], histogram(cohort.replace(" AS f", ""), "Recency", 35))
    high = "Risk_Tier = 'High Risk'"
    money, high_money = MONEY.format("Monetary"), f"CAST(sum(CAST(Monetary AS DECIMAL(20, 4))) FILTER ({high}) AS DOUBLE)"
    sql["g17_executive_kpis"] = w(
        ["rk", "obs"],
        f"""SELECT (SELECT count(DISTINCT CustomerID) FROM obs) AS identified_customers, count(*) AS eligible_customers,
            {money} AS historical_revenue, count(*) FILTER ({high}) AS high_risk_customers, {high_money} AS high_risk_revenue,
            {share(f"count(*) FILTER ({high})", "count(*)", 1)} AS high_risk_pct,
            {share(high_money, money, 1)} AS high_risk_revenue_pct FROM rk""",
    )
    sql["g18_monthly_revenue"] = w(
        ["obs"],
        f"SELECT CAST(date_trunc('month', InvoiceDate) AS DATE) AS month, {MONEY.format('Revenue')} AS revenue FROM obs GROUP BY 1",
    )
    sql["g19_executive_insights"] = w(
        ["rk"],
        f"""SELECT {text_percent("avg(Churn_90D) * 100")} AS inactivity_rate, count(*) FILTER ({high}) AS high_risk_customers,
            {text_percent(f"count(*) FILTER ({high})::DOUBLE / count(*) * 100")} AS high_risk_share,
            {text_pounds(high_money)} AS high_risk_revenue,
            {text_percent(f"{high_money} / {money} * 100")} AS high_risk_revenue_share,
            max(seg) AS dominant_segment, max(seg_n) AS dominant_customers,
            {text_percent("max(seg_n)::DOUBLE / count(*) * 100")} AS dominant_share
            FROM rk, (SELECT name AS seg, count(*) AS seg_n FROM rk JOIN {SEGMENTS} ON RFM_Segment = name
                      GROUP BY position, name ORDER BY seg_n DESC, position LIMIT 1) AS top""",
    )
    sql["g20_cohort_kpis"] = w(
        ["ct"],
        f"""SELECT count(*) AS customers, {money} AS revenue, round(avg(AvgOrderValue), 4) AS mean_order_value,
            round(avg(Recency), 4) AS mean_recency FROM {cohort}""",
    )
    sql["g21_filtered_tier_counts"] = w(
        ["rk"],
        """SELECT count(*) AS customers, count(*) FILTER (Risk_Tier = 'High Risk') AS high_risk,
                  count(*) FILTER (Risk_Tier = 'Medium Risk') AS medium_risk, count(*) FILTER (Risk_Tier = 'Low Risk') AS low_risk
           FROM rk WHERE Country IN ('NATION_1', 'NATION_4', 'NATION_9')""",
    )

    def pick(source, name, order):
        return f'(SELECT {{}} FROM ({source}) AS t ORDER BY {order}, position LIMIT 1)'.replace("{name}", name)

    picks = {
        "worst_recency": (RECENCY_RATES, '"RecencyBand"', "inactive_rate_pct", "inactive_rate_pct DESC"),
        "best_recency": (RECENCY_RATES, '"RecencyBand"', "inactive_rate_pct", "inactive_rate_pct"),
        "worst_frequency": (FREQUENCY_RATES, '"FreqGroup"', "inactive_rate_pct", "inactive_rate_pct DESC"),
        "top_segment": (SEGMENT_REVENUE, "RFM_Segment", "revenue_share_pct", "revenue_share_pct DESC NULLS LAST"),
    }
    cells = []
    for key, (source, name, value, order) in picks.items():
        template = pick(source, name, order)
        cells += [f"{template.replace('{}', name)} AS {key}", f"{template.replace('{}', value)} AS {key}_pct"]
    sql["g22_extreme_bands"] = w(["ct"], "SELECT (SELECT count(*) FROM ct) AS customers, " + ", ".join(cells))
    sql["g23_medians_and_means"] = w(
        ["ct"],
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", round(median(CAST({c} AS DOUBLE)), 4) AS median, round(avg({c}), 4) AS mean FROM ct"""
            for c in rfm
        ),
    )

    # top-k and sets
    sql["k1_country_revenue"] = w(
        ["obs"],
        f"SELECT Country, {MONEY.format('Revenue')} AS revenue FROM obs GROUP BY Country ORDER BY revenue DESC, Country LIMIT 10",
    )
    sql["k2_top_qualified_countries"] = w(["ql"], top.format("ql"))
    sql["k4_preview"] = w(["ct"], f"{table} ORDER BY CustomerID LIMIT 3")
    sql["u1_distinct_buyers"] = w(["fut"], "SELECT DISTINCT CustomerID FROM fut")
    sql["u2_returning_customers"] = w(
        ["elig", "fut"], "SELECT CustomerID FROM elig INTERSECT SELECT CustomerID FROM fut"
    )

    # insights
    sql["i1_risk_tiers"] = w(["rk"], "SELECT CustomerID, Churn_Probability_Raw, Risk_Tier FROM rk")
    sql["i2_j8_retention_priority"] = w(["rk"], "SELECT CustomerID, Risk_Tier, RFM_Segment, Retention_Priority FROM rk")
    sql["i2_priority_matrix"] = w(
        ["rk"],
        """SELECT Risk_Tier, RFM_Segment, Retention_Priority, count(*) AS customers FROM rk GROUP BY ALL""",
    )
    sql["s13_enriched_customers"] = w(
        ["rk"],
        f"SELECT {TABLE_COLUMNS}, Churn_Probability_Raw, Churn_Probability, Risk_Tier, Retention_Priority FROM rk",
    )

    # model and evaluation
    sql["m2_split"] = w(["sp"], f"SELECT {SPLIT_COLUMNS} FROM sp")
    sql["m4_class_weights"] = w(
        ["sp"],
        """SELECT CustomerID, Churn_90D, count(*) OVER ()::DOUBLE / (2 * count(*) OVER (PARTITION BY Churn_90D)) AS weight
           FROM sp WHERE NOT is_test""",
    )
    sql["m5_published_score"] = w(
        ["pb"], "SELECT CustomerID, Churn_Probability_Raw, CASE WHEN Churn_Probability_Raw > 0.5 THEN 1 ELSE 0 END AS Predicted_Class FROM pb"
    )
    sql["s11_test_predictions"] = w(
        ["te"],
        f"""SELECT CustomerID, Churn_90D, Churn_Probability_Raw AS Churn_Probability,
            CASE WHEN Churn_Probability_Raw > 0.5 THEN 1 ELSE 0 END AS Predicted_Class, {", ".join(PREDICTORS)} FROM te""",
    )
    sql["e1_e2_e3_metrics"] = w(["cum"], METRICS)
    sql["e4_threshold_table"] = w(
        ["te"],
        f"""SELECT threshold, round({zero("tp::DOUBLE / nullif(tp + fp, 0)")}, 6) AS "precision",
            round({zero("tp::DOUBLE / nullif(pos, 0)")}, 6) AS recall,
            round({zero("2.0::DOUBLE * tp / nullif(tp + fp + pos, 0)")}, 6) AS f1
            FROM (SELECT threshold, count(*) FILTER (Churn_90D = 1) AS pos,
                         count(*) FILTER (Churn_90D = 1 AND Churn_Probability_Raw >= threshold) AS tp,
                         count(*) FILTER (Churn_90D = 0 AND Churn_Probability_Raw >= threshold) AS fp
                  FROM te, {THRESHOLDS} GROUP BY threshold) AS t""",
    )
    sql["e5_confusion_matrix"] = w(
        ["te"],
        """SELECT actual, predicted, count(CustomerID) AS customers
           FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(actual, predicted)
           LEFT JOIN te ON Churn_90D = actual AND (Churn_Probability_Raw > 0.5)::INT = predicted GROUP BY 1, 2""",
    )
    sql["e6_roc_points"] = w(
        ["cum"],
        """SELECT round(cneg::DOUBLE / tneg, 6) AS fpr, round(cpos::DOUBLE / tpos, 6) AS tpr, p AS threshold FROM cum
           UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE, NULL""",
    )
    sql["e7_precision_recall_points"] = w(
        ["cum"],
        """SELECT round(cpos::DOUBLE / (cpos + cneg), 6) AS "precision", round(cpos::DOUBLE / tpos, 6) AS recall, p AS threshold
           FROM cum UNION ALL SELECT 1.0::DOUBLE, 0.0::DOUBLE, NULL""",
    )
    sql["e8_split_sizes"] = w(
        ["sp"],
        """SELECT is_test, count(*) AS customers, count(*) FILTER (Churn_90D = 0) AS class_0,
                  count(*) FILTER (Churn_90D = 1) AS class_1 FROM sp GROUP BY is_test""",
    )
    sql["s12_saved_model_difference"] = w(
        ["ct"], "SELECT count(*) AS customers, 0.0::DOUBLE AS largest_difference FROM ct"
    )
    sql["s10_s15_e8_report_of_stand_in_score"] = w(
        ["sp", "cum"],
        f"""SELECT s.*, m.*, 0.5::DOUBLE AS default_threshold, CAST(9 AS INT) AS thresholds, CAST(9 AS INT) AS coefficients
            FROM (SELECT count(*) FILTER (NOT is_test) AS train_size, count(*) FILTER (is_test) AS test_size FROM sp) AS s,
                 ({METRICS}) AS m""",
    )
    sql["r1_summary"] = w(["ct", "obs", "fut"], summary())

    # the fitted regression
    sql["m1_m3_m6_i4_fitted_coefficients"] = w(["coef"], "SELECT * FROM coef")
    sql["m1_m3_fitted_weights"] = w(
        ["fit"],
        f"""SELECT CAST(position - 1 AS INTEGER) AS position, feature, round(mean, 6) AS mean, round(deviation, 6) AS deviation,
                   round(coefficient, 6) AS coefficient
            FROM (SELECT unnest(range(1, {newton.N + 1})) AS position, unnest({newton.NAMES + ["(intercept)"]}) AS feature,
                         unnest(list_append(mu, 0.0::DOUBLE)) AS mean, unnest(list_append(sd, 1.0::DOUBLE)) AS deviation,
                         unnest(beta) AS coefficient FROM fit) AS t""",
    )
    sql["k3_strongest_coefficients"] = w(
        ["coef"],
        """SELECT * FROM (SELECT * FROM coef WHERE coefficient > 0 ORDER BY coefficient DESC, feature LIMIT 3) AS a
           UNION ALL SELECT * FROM (SELECT * FROM coef WHERE coefficient < 0 ORDER BY coefficient, feature LIMIT 3) AS b""",
    )
    sql["m5_fitted_score"] = w(
        ["pbf"], "SELECT CustomerID, Churn_Probability_Raw, CASE WHEN Churn_Probability_Raw > 0.5 THEN 1 ELSE 0 END AS Predicted_Class FROM pbf"
    )
    sql["m5_model_against_weights"] = w(["ct"], "SELECT count(*) AS customers, count(*) AS near FROM ct")
    sql["s12_saved_model_scores"] = w(["pbf"], "SELECT CustomerID, Churn_Probability_Raw FROM pbf")
    sql["s13_enriched_by_fitted_model"] = w(
        ["rkf"], f"SELECT {TABLE_COLUMNS}, Churn_Probability_Raw, Churn_Probability, Risk_Tier, Retention_Priority FROM rkf"
    )
    sql["s10_s15_evaluation_file"] = w(["spf", "cumf", "coef"], _evaluation_rows())

    # checks
    sql["v1_label_check"] = w(
        ["ct"],
        """SELECT count(*) FILTER (Churn_90D IS NULL) AS missing_labels,
                  count(*) FILTER (Churn_90D NOT IN (0, 1)) AS non_binary_labels,
                  count(*) - count(DISTINCT CustomerID) AS repeated_customers FROM ct""",
    )
    sql["v2_v3_v6_s3_u3_column_checks"] = w(
        ["ct"],
        """SELECT count(*) AS customers, CAST(17 AS INT) AS columns, CAST(0 AS INT) AS missing_columns,
                  CAST(0 AS INT) AS columns_of_the_label_window, CAST(0 AS INT) AS forbidden_predictors FROM ct""",
    )
    sql["v4_window_check"] = w(
        ["obs", "fut", "ct"],
        """SELECT (SELECT count(*) FROM obs WHERE CAST(InvoiceDate AS DATE) > DATE '{snapshot}') AS late_observation_rows,
                  CASE WHEN EXISTS (SELECT 1 FROM obs WHERE CAST(InvoiceDate AS DATE) = DATE '{snapshot}') THEN 0 ELSE 1 END
                      AS snapshot_day_missing,
                  (SELECT count(*) FROM fut WHERE CAST(InvoiceDate AS DATE) NOT BETWEEN DATE '{start}' AND DATE '{end}')
                      AS future_rows_outside,
                  (SELECT count(*) FROM ct WHERE Recency < 0) AS negative_recency""",
    )
    sql["v5_population_counts"] = w(
        ["ql", "sp"],
        """SELECT count(*) AS eligible_customers, count(*) FILTER (Churn_90D = 1) AS inactive,
                  count(*) FILTER (Churn_90D = 0) AS active, (SELECT count(*) FROM ql) AS qualified_rows,
                  count(*) FILTER (NOT is_test) AS train_size, count(*) FILTER (is_test) AS test_size,
                  count(*) FILTER (Risk_Tier = 'High Risk') AS high_risk, count(*) FILTER (Risk_Tier = 'Medium Risk') AS medium_risk,
                  count(*) FILTER (Risk_Tier = 'Low Risk') AS low_risk FROM sp""",
    )
    return sql


def _evaluation_rows() -> str:
    """The evaluation report of the fitted score, value by value."""
    of = lambda side, label: f"count(*) FILTER ({'' if side == 'test' else 'NOT '}is_test{label})"
    one = [("train_size", of("train", "")), ("test_size", of("test", ""))]
    one += [(f"class_counts.{side}.{c}", of(side, f" AND Churn_90D = {c}")) for side in ("train", "test") for c in (0, 1)]
    number = "SELECT '{}' AS path, CAST({} AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text FROM {}"
    parts = [number.format(path, value, "spf") for path, value in one]
    parts += [number.format(c, f'"{c}"', "m") for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")]
    parts.append(number.format("default_threshold", "0.5", "(SELECT 1) AS one"))
    for c in ("threshold", "precision", "recall", "f1"):
        parts.append(
            f"""SELECT 'threshold_analysis[' || (row_number() OVER (ORDER BY threshold) - 1) || '].{c}', "{c}", NULL FROM th"""
        )
    for c in ("coefficient", "abs_coefficient"):
        parts.append(f"SELECT 'feature_coefficients[' || place || '].{c}', {c}, NULL FROM ranked")
    parts.append("SELECT 'feature_coefficients[' || place || '].feature', NULL, feature FROM ranked")
    return f"""SELECT * FROM (
        WITH m AS ({METRICS.replace("FROM cum", "FROM cumf")}),
             th AS ({_threshold_rows("spf WHERE is_test")}),
             ranked AS (SELECT *, row_number() OVER (ORDER BY abs_coefficient DESC, feature) - 1 AS place FROM coef)
        {" UNION ALL ".join(parts)}) AS report"""


def _threshold_rows(source: str) -> str:
    return f"""SELECT threshold, round({zero("tp::DOUBLE / nullif(tp + fp, 0)")}, 6) AS "precision",
            round({zero("tp::DOUBLE / nullif(pos, 0)")}, 6) AS recall,
            round({zero("2.0::DOUBLE * tp / nullif(tp + fp + pos, 0)")}, 6) AS f1
            FROM (SELECT threshold, count(*) FILTER (Churn_90D = 1) AS pos,
                         count(*) FILTER (Churn_90D = 1 AND Churn_Probability_Raw >= threshold) AS tp,
                         count(*) FILTER (Churn_90D = 0 AND Churn_Probability_Raw >= threshold) AS fp
                  FROM (SELECT * FROM {source}) AS held, {THRESHOLDS} GROUP BY threshold) AS t"""


def _band_of(column: str, name: str, rates: str) -> str:
    """Per customer, from the same bands as the rate table."""
    bands = rates.split("FROM", 1)[1].split("JOIN (SELECT *,")[0]
    return f"""SELECT CustomerID, label AS "{name}" FROM {bands} JOIN (SELECT *, {column} AS v FROM ct) AS x
               ON v > above AND v <= upto"""
