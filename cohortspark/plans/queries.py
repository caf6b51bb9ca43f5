"""Every operator as a named query over the order tables: (session, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.config import FEATURE_COLUMNS, LABEL, NON_PREDICTORS, PREDICTORS, SEGMENTS
from cohortspark.functions import bands
from cohortspark.functions.ranking import global_rank
from cohortspark.operators import audit, checks, cleaning, cohort, evaluation, features, insights, model, scoring, weights
from cohortspark.plans import explorer, reports
from cohortspark.plans.catalog import event_pipeline, order_pipeline
from cohortspark.plans.pipeline import fingerprint
from cohortspark.session import stored
from cohortspark.sources import tables
from cohortspark.sources.starschema import EARLY, LATE

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Example choices of the filter controls.
COUNTRIES = ["NATION_1", "NATION_4", "NATION_9"]
FILE_BYTES = 64 << 20  # stored lines for each CSV file with quoted line breaks


def query(name: str):
    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return register


def on_raw(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: build(order_pipeline(spark, folder).raw())


def on_copies(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: build(order_pipeline(spark, folder).copies())


def on_lines(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: build(order_pipeline(spark, folder).qualified())


def on_sliced(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: build(order_pipeline(spark, folder).by_customer())


def on_customers(name: str, build: Callable[[DataFrame], DataFrame], windows=LATE) -> None:
    QUERIES[name] = lambda spark, folder: build(order_pipeline(spark, folder, windows).customers())


def published_risk(spark: SparkSession, folder: str) -> DataFrame:
    """The risk table scored with the published coefficients, which SQL can follow."""
    return order_pipeline(spark, folder).risk(model.published_score, "published")


def on_risk(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: build(published_risk(spark, folder))


def published_split(spark: SparkSession, folder: str) -> DataFrame:
    """The published-score table with is_test."""
    p = order_pipeline(spark, folder)
    return p.stage("published_split", lambda: model.with_split(published_risk(spark, folder)))


def held_out(spark: SparkSession, folder: str) -> DataFrame:
    return published_split(spark, folder).filter("is_test")


def on_held_out(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: build(held_out(spark, folder))


# ---------------------------------------------------------------- sources and sinks


@query("s1_raw_lines")
def _(spark, folder):
    p = order_pipeline(spark, folder)
    path = p.path("raw_csv", with_windows=False)
    p.raw().write.mode("overwrite").option("header", True).csv(path)
    return tables.read_raw(spark, path, "csv")


@query("s1_quoted_line_breaks")
def _(spark, folder):
    """Raw lines with a line break and quotes in some descriptions, written to CSV files and read by many tasks.

    One file for each FILE_BYTES of stored lines, so a file still has several blocks and no task writes more than that.
    """
    p = order_pipeline(spark, folder)
    path = p.path("raw_breaks", with_windows=False)
    broken = F.concat(F.col("Description"), F.lit('\n"second", line\n'), F.col("StockCode"))
    lines = p.raw().withColumn("Description", F.when(F.col("StockCode").endswith("7"), broken).otherwise(F.col("Description")))
    files = max(1, -(-fingerprint(p.raw())[1] // FILE_BYTES))
    lines.coalesce(files).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return tables.read_raw(spark, path, "csv")


@query("s2_missing_inputs")
def _(spark, folder):
    """Each input that is there with its rows, and the same one looked for where it is not, with the error's class."""
    p = order_pipeline(spark, folder)
    saved = p.path("inputs_weights")
    weights.save_weights(p.weights(), saved)
    raw = p.path("inputs_raw", with_windows=False)
    p.raw().write.mode("overwrite").parquet(raw)
    inputs = {
        "raw": (lambda path: tables.read_raw(spark, path), raw),
        "qualified": (lambda path: tables.read_qualified(spark, path), tables.write_qualified(p.qualified(), p.path("inputs_qualified"))),
        "features": (lambda path: tables.read_features(spark, path), tables.write_features(p.customers(), p.path("inputs_features"))),
        "weights": (lambda path: weights.load_weights(spark, path), saved),
    }
    rows = []
    for what, (read, path) in inputs.items():
        for there, place in ((True, path), (False, f"{path}-absent")):
            try:
                rows.append((what, there, read(place).count(), None))
            except FileNotFoundError as error:
                rows.append((what, there, None, type(error).__name__))
    try:
        model.load_model(p.path("absent_model"))
    except FileNotFoundError as error:
        rows.append(("model", False, None, type(error).__name__))
    return spark.createDataFrame(rows, "what string, there boolean, rows bigint, error string")


@query("s4_lenient_dates")
def _(spark, folder):
    lines = order_pipeline(spark, folder).raw()
    written = F.when(F.col("Description").isNotNull(), F.col("InvoiceDate").cast("string")).otherwise("not a date")
    texts = lines.select("InvoiceNo", "StockCode", "Quantity", written.alias("InvoiceDate"))
    return texts.withColumn("InvoiceDate", tables.lenient_timestamp("InvoiceDate"))


@query("s5_s6_qualified_roundtrip")
def _(spark, folder):
    p = order_pipeline(spark, folder)
    path = tables.write_qualified(p.qualified(), p.path("qualified_csv", with_windows=False), "csv")
    return tables.read_qualified(spark, path, "csv")


@query("s7_audit_file")
def _(spark, folder):
    p = order_pipeline(spark, folder)
    report = audit.audit_report(p.raw(), p.qualified())
    path = tables.write_report(report, p.path("audit_json", with_windows=False))
    return tables.read_report(spark, path, report.schema)


@query("s8_s16_features_roundtrip")
def _(spark, folder):
    p = order_pipeline(spark, folder)
    return tables.read_features(spark, tables.write_features(p.customers(), p.path("features_csv"), "csv"), "csv")


@query("s9_summary_file")
def _(spark, folder):
    p = order_pipeline(spark, folder)
    report = reports.summary_report(p.customers(), p.qualified(), p.windows)
    return reports.flat_summary(tables.read_report(spark, tables.write_report(report, p.path("summary_json")), report.schema))


@query("s10_s15_evaluation_file")
def _(spark, folder):
    p = order_pipeline(spark, folder)
    report = evaluation.evaluation_report(weights.score(p.weights(), p.split()), weights.coefficients(p.weights()))
    written = tables.write_report(report, p.path("evaluation_json"))
    return evaluation.flat_report(tables.read_report(spark, written, report.schema))


@query("s11_test_predictions")
def _(spark, folder):
    p = order_pipeline(spark, folder)
    rows = held_out(spark, folder).withColumn("Churn_Probability", F.col("Churn_Probability_Raw"))
    path = tables.write_test_predictions(rows.withColumn("Predicted_Class", model.decide()), p.path("predictions"))
    return spark.read.parquet(path)


@query("s12_saved_model_scores")
def _(spark, folder):
    p = order_pipeline(spark, folder)
    path = p.path("saved_weights")
    version = weights.save_weights(p.weights(), path)
    loaded = weights.load_weights(spark.newSession(), path, version)
    held = spark.createDataFrame(loaded.collect(), loaded.schema)  # ten rows, from the other session
    return weights.score(held, p.customers()).select("CustomerID", "Churn_Probability_Raw")


on_risk("s13_enriched_customers", lambda r: r.select(*FEATURE_COLUMNS, "Churn_Probability_Raw", "Churn_Probability", "Risk_Tier", "Retention_Priority"))
@query("s12_saved_model_difference")
def _(spark, folder):
    """The saved and loaded model against the one in memory: customers, and the largest difference of a score."""
    p = order_pipeline(spark, folder)
    loaded = model.load_model(model.save_model(p.model(), p.path("model_again")))
    one = model.score(p.model(), p.customers()).select("CustomerID", F.col("Churn_Probability_Raw").alias("a"))
    two = model.score(loaded, p.customers()).select("CustomerID", F.col("Churn_Probability_Raw").alias("b"))
    largest = F.max(F.abs(F.col("a") - F.col("b"))).alias("largest_difference")
    return one.join(two, "CustomerID").agg(F.count(F.lit(1)).alias("customers"), largest)


@query("s10_s15_e8_report_of_stand_in_score")
def _(spark, folder):
    """The evaluation report as written and read again, on the score that SQL can express."""
    p = order_pipeline(spark, folder)
    published = [(c, k, abs(k)) for c, k in model.PUBLISHED_COEFFICIENTS.items()]
    coefficients = spark.createDataFrame(published, "feature string, coefficient double, abs_coefficient double")
    report = evaluation.evaluation_report(published_split(spark, folder), coefficients)
    back = tables.read_report(spark, tables.write_report(report, p.path("stand_in_json")), report.schema)
    measures = ["train_size", "test_size", "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "default_threshold"]
    sizes = [F.size(c).alias(n) for c, n in (("threshold_analysis", "thresholds"), ("feature_coefficients", "coefficients"))]
    return back.select(*measures, *sizes)


QUERIES["s13_enriched_by_fitted_model"] = lambda spark, folder: order_pipeline(spark, folder).risk()
on_lines("s14_trend_lines", lambda q: tables.transactions_for_trends(q, LATE).select("InvoiceDate", "CustomerID", "Country", "Revenue"))

# ---------------------------------------------------------------- audit

on_raw("a1_audit", audit.audit)
on_copies("a2_duplicates", audit.duplicates_of)
on_raw("a3_audit_aliases", lambda raw: audit.with_aliases(audit.audit(raw)).select(*audit.AUDIT_ALIASES))
on_raw("a4_missing_values", audit.missing_values)
on_raw("a5_column_types", audit.column_types)
on_raw("a6_cancellation_share", audit.cancellation_share)
on_raw("a6_cancelled_countries", audit.cancelled_countries)
on_raw("a7_sign_profile", audit.sign_profile)
on_raw("a8_describe_raw", lambda raw: audit.describe(raw, ["Quantity", "UnitPrice"]))
on_lines("a8_describe_qualified", lambda q: audit.describe(q, ["Quantity", "UnitPrice", "Revenue"]))
on_customers("a8_describe_features", lambda t: audit.describe(t, PREDICTORS))
on_raw("a9_top_countries", audit.top_countries)
on_copies("a10_stage_counts", audit.stage_counts_of)
on_copies("a11_after_deduplication", audit.after_deduplication_of)
on_lines("a12_revenue_check", audit.revenue_check)
on_lines("a13_output_check", audit.output_check)
on_lines("a14_window_summary", lambda q: audit.window_summary(q, LATE))

# ---------------------------------------------------------------- cleaning, windows, explorer

on_raw("c1_fill_descriptions", cleaning.fill_descriptions)
on_copies("c2_drop_duplicates", cleaning.distinct_lines)
on_raw("c3_flag_cancellations", cleaning.flag_cancellations)
on_raw("c4_c5_qualifying_filter", cleaning.qualifying)
on_lines("c6_observation_window", lambda q: cohort.observation_lines(q, LATE))
on_lines("c7_future_window", lambda q: cohort.future_lines(q, LATE))


@query("c8_directory_filter")
def _(spark, folder):
    chosen = explorer.directory_filter(
        published_risk(spark, folder), COUNTRIES, ["High Risk", "Medium Risk"], ["Lower Value", "Medium Value"]
    )
    return chosen.select("CustomerID", "Country", "Risk_Tier", "RFM_Segment")


def _cohort(table: DataFrame) -> DataFrame:
    return explorer.cohort_filter(table, (30, 400), (300_000, 1_500_000), (), ["High Value", "Medium Value"])


on_customers("c9_cohort_filter", _cohort)
on_customers("c10_country_options", explorer.country_options)
on_customers("c10_segment_options", explorer.segment_options)
on_customers("c10_range_options", explorer.range_options)
on_customers("c11_lookup", lambda t: explorer.lookup(t, " 7.0 "))
on_risk("c12_directory", explorer.directory)
on_risk("c13_profile", explorer.profile)
on_customers("c14_c15_scatter", lambda t: reports.scatter(t, "Frequency", "Monetary", {"Frequency": 60, "Monetary": 15000}, LABEL))
on_customers("c15_scatter_recency_monetary", lambda t: reports.scatter(t, "Recency", "Monetary"))
on_customers("c15_scatter_recency_frequency", lambda t: reports.scatter(t, "Recency", "Frequency", {"Frequency": 60}, LABEL))

# ---------------------------------------------------------------- joins

on_sliced("j1_lines_of_eligible", lambda q: cohort.lines_of_eligible(q, LATE))
on_lines("j2_active_months", lambda q: features.behaviour(q, LATE).select("CustomerID", "ActiveMonths"))


@query("j5_attach_label")
def _(spark, folder):
    lines = order_pipeline(spark, folder).qualified()
    labels = cohort.inactivity_label(lines, cohort.eligible_customers(lines, LATE), LATE)
    return features.attach_label(features.behaviour(lines, LATE), labels)


on_sliced("j5_labelled_behaviour", lambda q: features.labelled_behaviour(q, LATE))


@query("j6_model_rows")
def _(spark, folder):
    p = order_pipeline(spark, folder)
    return model.model_rows(p.labelled(), p.labelled().select("CustomerID", LABEL))


@query("j7_i3_risk_table")
def _(spark, folder):
    probabilities = published_risk(spark, folder).select("CustomerID", "Churn_Probability_Raw")
    stored = order_pipeline(spark, folder).customers()
    return insights.risk_table(stored, probabilities)


QUERIES["j10_split_overlap"] = lambda spark, folder: checks.split_overlap(published_split(spark, folder))

# ---------------------------------------------------------------- ranks, scores, bands

SCORES = ["CustomerID", "R", "F", "M", "RFM_Score", "RFM_Segment"]
QUERIES["w1_w2_w3_rfm_scores"] = lambda spark, folder: scoring.add_rfm_scores(order_pipeline(spark, folder).labelled()).select(*SCORES)
QUERIES["w1_rank_rule_scores"] = lambda spark, folder: scoring.add_rfm_scores(
    order_pipeline(spark, folder, EARLY).labelled()
).select(*SCORES)
on_lines("w4_main_country", lambda q: features.main_country(cohort.observation_lines(q, LATE)))
on_customers("w5_frequency_group", lambda t: scoring.frequency_group(t).select("CustomerID", "Frequency_Group"))


@query("w6_global_rank")
def _(spark, folder):
    table = stored(features.behaviour(order_pipeline(spark, folder).qualified(), LATE), "behaviour")
    return global_rank(table.select("CustomerID", "Frequency"), "Frequency")


@query("w6_global_rank_descending")
def _(spark, folder):
    table = stored(features.behaviour(order_pipeline(spark, folder).qualified(), LATE), "behaviour")
    return global_rank(table.select("CustomerID", "Recency"), "Recency", ascending=False)


on_customers("w7_dashboard_recency_band", lambda t: t.select("CustomerID", bands.dashboard_recency_band().alias("Recency_Band")))


@query("w8_notebook_recency_band")
def _(spark, folder):
    table = order_pipeline(spark, folder).customers()
    longest = table.agg(F.max("Recency")).first()[0]
    return table.select("CustomerID", bands.notebook_recency_band(longest).alias("RecencyBand"))


on_customers("w9_frequency_band", lambda t: t.select("CustomerID", bands.frequency_band().alias("FreqGroup")))
on_customers("w10_value_group", lambda t: scoring.value_group(t).select("CustomerID", "Value_Group"))

# ---------------------------------------------------------------- aggregations

on_lines("g1_eligible_customers", lambda q: cohort.eligible_customers(q, LATE))


@query("g1_eligible_event_customers")
def _(spark, folder):
    p = event_pipeline(spark, folder)
    return cohort.eligible_customers(p.qualified(), p.windows)


on_lines("g2_customer_features", lambda q: features.customer_features(q, LATE))


@query("g3_inactivity_label")
def _(spark, folder):
    lines = order_pipeline(spark, folder).qualified()
    return cohort.inactivity_label(lines, cohort.eligible_customers(lines, LATE), LATE)


@query("g4_customer_table")
def _(spark, folder):
    return order_pipeline(spark, folder).customers()


@query("g4_customer_table_early")
def _(spark, folder):
    return order_pipeline(spark, folder, EARLY).customers()


@query("g4_event_customer_table")
def _(spark, folder):
    return event_pipeline(spark, folder).customers()


on_customers("g5_rate_by_segment", lambda t: insights.rate_by_group(t, "RFM_Segment"))
on_customers("g6_recency_rates", reports.recency_rates)
on_customers("g6_frequency_rates", reports.frequency_rates)
on_customers("g6_value_rates", reports.value_rates)
on_customers("g7_recency_band_rates", reports.recency_band_rates)
on_customers("g7_frequency_band_rates", reports.frequency_band_rates)
on_customers("g8_segment_revenue", reports.segment_revenue)
on_customers("g9_segment_inactivity", reports.segment_inactivity)
on_customers("g10_segment_counts", reports.segment_distribution)
on_risk("g10_tier_counts", reports.tier_distribution)
on_customers("g10_score_counts", reports.score_distribution)
on_customers("g10_class_counts", reports.class_distribution)
on_customers("g11_class_balance", reports.class_balance)
on_customers("g12_correlations", reports.correlations)
on_customers("g13_quantile_table", reports.quantile_table)
on_customers("g14_box_statistics", reports.box_statistics)
on_customers("g15_recency_histogram", lambda t: reports.histogram(t, "Recency", 40))
on_customers("g15_frequency_histogram", lambda t: reports.histogram(t, "Frequency", 40, cap=50))
on_customers("g15_monetary_histogram", lambda t: reports.histogram(t, "Monetary", 40, cap=1_000_000))
on_risk("g16_probability_histogram", lambda r: reports.histogram(r, "Churn_Probability", 40))
on_risk("g16_probability_by_tier", lambda r: reports.histogram(r, "Churn_Probability", 35, group="Risk_Tier"))
on_customers("g16_filtered_recency_histogram", lambda t: reports.histogram(_cohort(t), "Recency", 35))


@query("g17_executive_kpis")
def _(spark, folder):
    return reports.executive_kpis(published_risk(spark, folder), order_pipeline(spark, folder).qualified(), LATE)


on_lines("g18_monthly_revenue", lambda q: reports.monthly_revenue(q, LATE))
on_risk("g19_executive_insights", reports.executive_insights)
on_customers("g20_cohort_kpis", lambda t: explorer.cohort_kpis(_cohort(t)))
on_risk("g21_filtered_tier_counts", lambda r: explorer.tier_counts(explorer.directory_filter(r, COUNTRIES)))
on_customers("g22_extreme_bands", reports.extreme_bands)
on_customers("g23_medians_and_means", reports.medians_and_means)

# ---------------------------------------------------------------- top-k and sets

on_lines("k1_country_revenue", lambda q: reports.country_revenue(q, LATE))
on_lines("k2_top_qualified_countries", audit.top_countries)


@query("k3_strongest_coefficients")
def _(spark, folder):
    return model.strongest(weights.coefficients(order_pipeline(spark, folder).weights()))


on_customers("k4_preview", lambda t: explorer.preview(t, 3, "CustomerID"))
on_lines("u1_distinct_buyers", lambda q: cohort.future_lines(q, LATE).select("CustomerID").distinct())
on_lines(
    "u2_returning_customers",
    lambda q: cohort.eligible_customers(q, LATE).intersect(cohort.future_lines(q, LATE).select("CustomerID")),
)

# ---------------------------------------------------------------- insights

on_risk("i1_risk_tiers", lambda r: insights.risk_tiers(r.drop("Risk_Tier")).select("CustomerID", "Churn_Probability_Raw", "Risk_Tier"))
on_risk(
    "i2_j8_retention_priority",
    lambda r: r.select("CustomerID", "Risk_Tier", "RFM_Segment", insights.retention_priority().alias("Retention_Priority")),
)
on_risk(
    "i2_priority_matrix",
    lambda r: r.groupBy("Risk_Tier", "RFM_Segment", "Retention_Priority").agg(F.count(F.lit(1)).alias("customers")),
)

# ---------------------------------------------------------------- model

QUERIES["m2_split"] = lambda spark, folder: order_pipeline(spark, folder).split()


@query("m1_m3_m6_i4_fitted_coefficients")
def _(spark, folder):
    return weights.coefficients(order_pipeline(spark, folder).weights())


@query("m1_m3_fitted_weights")
def _(spark, folder):
    found = order_pipeline(spark, folder).weights()
    shown = [F.round(c, 6).alias(c) for c in ("mean", "deviation", "coefficient")]
    return found.select("position", "feature", *shown)


@query("m4_class_weights")
def _(spark, folder):
    rows = order_pipeline(spark, folder).split().filter("NOT is_test")
    weighted = model.with_weight(rows, model.class_weights(model.class_counts(rows)))
    return weighted.select("CustomerID", LABEL, F.col(model.WEIGHT).alias("weight"))


@query("m5_fitted_score")
def _(spark, folder):
    p = order_pipeline(spark, folder)
    scored = weights.score(p.weights(), p.customers())
    return scored.select("CustomerID", "Churn_Probability_Raw", model.decide().alias("Predicted_Class"))


@query("m5_model_against_weights")
def _(spark, folder):
    """Customers whose probability by the saved pipeline is within a thousandth of that by the weights, and all."""
    p = order_pipeline(spark, folder)
    one = model.score(p.model(), p.customers()).select("CustomerID", F.col("Churn_Probability_Raw").alias("a"))
    two = weights.score(p.weights(), p.customers()).select("CustomerID", F.col("Churn_Probability_Raw").alias("b"))
    near = F.count_if(F.abs(F.col("a") - F.col("b")) < 0.001)
    return one.join(two, "CustomerID").agg(F.count(F.lit(1)).alias("customers"), near.alias("near"))


on_customers(
    "m5_published_score",
    lambda t: model.published_score(t).select("CustomerID", "Churn_Probability_Raw", model.decide().alias("Predicted_Class")),
)

# ---------------------------------------------------------------- evaluation

on_held_out("e1_e2_e3_metrics", evaluation.metrics)
on_held_out("e4_threshold_table", evaluation.threshold_table)
on_held_out("e5_confusion_matrix", evaluation.confusion_matrix)
on_held_out("e6_roc_points", evaluation.roc_points)
on_held_out("e7_precision_recall_points", evaluation.precision_recall_points)


@query("e8_split_sizes")
def _(spark, folder):
    return (
        order_pipeline(spark, folder)
        .split()
        .groupBy("is_test")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.count_if(F.col(LABEL) == 0).alias("class_0"),
            F.count_if(F.col(LABEL) == 1).alias("class_1"),
        )
    )


@query("r1_summary")
def _(spark, folder):
    p = order_pipeline(spark, folder)
    return reports.flat_summary(reports.summary_report(p.customers(), p.qualified(), p.windows))


# ---------------------------------------------------------------- checks

on_customers("v1_label_check", checks.label_violations)


def _column_checks(table: DataFrame) -> DataFrame:
    offending = {
        "missing_columns": tables.missing_columns(table, FEATURE_COLUMNS),
        "columns_of_the_label_window": checks.overlapping_columns(table),
        "forbidden_predictors": sorted(set(PREDICTORS) & set(NON_PREDICTORS)),
    }
    return table.agg(F.count(F.lit(1)).alias("customers")).select(
        "customers", F.lit(len(table.columns)).alias("columns"), *[F.lit(len(v)).alias(k) for k, v in offending.items()]
    )


on_customers("v2_v3_v6_s3_u3_column_checks", _column_checks)


@query("v4_window_check")
def _(spark, folder):
    p = order_pipeline(spark, folder)
    lines = p.qualified()
    return checks.window_violations(
        cohort.observation_lines(lines, LATE), cohort.future_lines(lines, LATE), p.customers(), LATE
    )


@query("v5_population_counts")
def _(spark, folder):
    p = order_pipeline(spark, folder)
    return checks.population_counts(p.qualified(), p.customers(), published_split(spark, folder))


# ---------------------------------------------------------------- flagship


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Inactivity of each segment, from raw lines to the scored customer table."""
    return reports.segment_inactivity(order_pipeline(spark, folder).customers()).filter(F.col("RFM_Segment").isin(*SEGMENTS))
