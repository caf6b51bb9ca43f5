"""The plans hold no step that grows beyond one task."""

import re

import pytest
from sample import SF_DIR

from cohortspark.operators import audit, cleaning, cohort, features, scoring
from cohortspark.plans import reports
from cohortspark.plans.catalog import order_pipeline
from cohortspark.plans.queries import QUERIES
from cohortspark.sources.starschema import LATE

# Windows without partition over a few category rows.
SMALL_WINDOWS = {"g8_segment_revenue", "g10_segment_counts", "g10_tier_counts", "g10_score_counts", "g10_class_counts", "g22_extreme_bands"}


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def unpartitioned_windows(plan: str) -> list[str]:
    """Window steps whose input was brought together into one partition."""
    steps = plan.split("\n")
    found = []
    for i, step in enumerate(steps):
        if re.search(r"\bWindow \[", step):
            below = next((s for s in steps[i + 1 :] if "Exchange" in s or "Scan" in s), "")
            if "SinglePartition" in below:
                found.append(step)
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_in_the_plan_and_no_cross_join(spark, name):
    plan = physical(QUERIES[name](spark, SF_DIR))
    for step in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoop"):
        assert step not in plan, step
    if name not in SMALL_WINDOWS:
        assert not unpartitioned_windows(plan)


def test_window_filter_reaches_the_file(spark):
    lines = order_pipeline(spark, SF_DIR).qualified()
    plan = physical(features.behaviour(lines, LATE))
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(InvoiceDate,2001-01-01T00:00", plan)
    assert "Description" not in plan.split("ReadSchema")[1]


def test_cleaning_filters_before_its_shuffle(spark):
    raw = order_pipeline(spark, SF_DIR).raw()
    plan = physical(cleaning.clean(raw))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "PushedFilters: [IsNotNull(CustomerID)" in plan or "IsNotNull(CustomerID)" in plan.split("PushedFilters")[1]
    assert plan.index("Exchange") < plan.index("Filter")  # printed from the top: the filter is below


def test_audit_shuffles_whole_rows_for_duplicates_alone(spark):
    raw = order_pipeline(spark, SF_DIR).raw()
    plain = physical(audit.with_aliases(audit.audit(raw)).select(*audit.AUDIT_ALIASES))
    assert "hashpartitioning" not in plain and plain.count("FileScan") == 1
    assert physical(audit.distinct_keys(raw)).count("hashpartitioning(k") == 1


def test_scoring_adds_no_shuffle(spark):
    plan = physical(scoring.add_rfm_scores(order_pipeline(spark, SF_DIR).labelled()))
    assert "Exchange" not in plan


def test_country_join_needs_no_extra_shuffle(spark):
    """Both sides of the join are already placed by CustomerID."""
    lines = order_pipeline(spark, SF_DIR).qualified()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = physical(features.labelled_features(lines, LATE))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("FileScan") == 2
    assert plan.count("Exchange hashpartitioning") == 4  # two per aggregation, none for the join


def test_category_tables_have_no_shuffle_by_category(spark):
    plan = physical(reports.segment_inactivity(order_pipeline(spark, SF_DIR).customers()))
    assert "hashpartitioning" not in plan


def test_questions_about_duplicates_shuffle_no_lines(spark):
    p = order_pipeline(spark, SF_DIR)
    for build in (audit.duplicates_of, audit.stage_counts_of, audit.after_deduplication_of, cleaning.distinct_lines):
        plan = physical(build(p.copies()))
        assert "hashpartitioning" not in plan


def without_broadcast(spark, build) -> str:
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return physical(build())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_by_customer_are_not_shuffled(spark):
    """The join's lines come from their buckets; what is shuffled has one row for each customer and slice."""
    lines = order_pipeline(spark, SF_DIR).by_customer()
    plan = without_broadcast(spark, lambda: cohort.lines_of_eligible(lines, LATE))
    exchanges = [step for step in plan.split("\n") if "Exchange hashpartitioning" in step]
    assert len(exchanges) == 2 and plan.count("Bucketed: true") == 2
    kept = plan.split("SortMergeJoin")[1].split("FileScan")[0]
    assert "Exchange" not in kept


def test_nothing_runs_while_the_join_of_lines_is_built(spark):
    lines = order_pipeline(spark, SF_DIR).by_customer()
    spark.sparkContext.setJobGroup("built", "j1")
    try:
        cohort.lines_of_eligible(lines, LATE)
        features.labelled_behaviour(lines, LATE)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("built")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_labels_come_from_one_read(spark):
    lines = order_pipeline(spark, SF_DIR).by_customer()
    plan = without_broadcast(spark, lambda: features.labelled_behaviour(lines, LATE))
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_stored_buckets_are_found_again(spark):
    """Without the table's name, as in a later session, the same files give the same table."""
    p = order_pipeline(spark, SF_DIR)
    rows = p.by_customer(4).count()
    table = next(t.name for t in spark.catalog.listTables() if spark.table(t.name).inputFiles() == p.by_customer(4).inputFiles())
    spark.sql(f"DROP TABLE {table}")
    p._tables.pop("by_customer_4")
    again = p.by_customer(4)
    assert again.count() == rows == p.qualified().count()
    assert "Bucketed: true" in without_broadcast(spark, lambda: cohort.lines_of_eligible(again, LATE))
