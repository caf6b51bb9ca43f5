import numpy as np
import pytest

from cohortspark.operators import evaluation


@pytest.fixture
def scored(spark):
    def build(labels, probabilities):
        rows = [(i, int(y), float(p)) for i, (y, p) in enumerate(zip(labels, probabilities))]
        return spark.createDataFrame(rows, "CustomerID bigint, Churn_90D int, Churn_Probability_Raw double")

    return build


def plain_metrics(y, p):
    y, p = np.array(y), np.array(p)
    c = p > 0.5
    tp, fp, fn = (c & (y == 1)).sum(), (c & (y == 0)).sum(), (~c & (y == 1)).sum()
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = (hit & (y == 1)).sum() / len(pos)
        ap, last = ap + (recall - last) * (hit & (y == 1)).sum() / hit.sum(), recall
    return {
        "accuracy": (c == (y == 1)).mean(),
        "precision": tp / (tp + fp) if tp + fp else 0.0,
        "recall": tp / (tp + fn),
        "f1": 2 * tp / (2 * tp + fp + fn),
        "roc_auc": auc,
        "pr_auc": ap,
    }


@pytest.mark.parametrize("digits, parts", [(1, 1), (6, 1), (6, 9), (1, 9)])
def test_metrics_against_plain_counting(scored, digits, parts):
    rng = np.random.default_rng(digits)
    p = rng.random(300).round(digits)
    y = (rng.random(300) < p).astype(int)
    got = evaluation.metrics(scored(y, p), digits=9, parts=parts).first().asDict()
    for name, want in plain_metrics(y, p).items():
        assert abs(got[name] - want) < 1e-8, name


def test_average_precision_is_the_step_sum(scored):
    row = evaluation.metrics(scored([1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1])).first()
    assert row["pr_auc"] == round((1 + 2 / 3) / 2, 6)


def test_nothing_above_one_half(scored):
    row = evaluation.metrics(scored([1, 0], [0.5, 0.2])).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_one_class_has_no_roc_area(scored):
    assert evaluation.metrics(scored([1, 1], [0.4, 0.6])).first()["roc_auc"] is None


def test_threshold_includes_equality(scored):
    rows = evaluation.threshold_table(scored([1, 0], [0.5, 0.4]), [0.5]).collect()
    assert tuple(rows[0]) == (0.5, 1.0, 1.0, 1.0)


def test_threshold_table_defaults(scored):
    rng = np.random.default_rng(0)
    rows = evaluation.threshold_table(scored(rng.integers(0, 2, 200), rng.random(200))).collect()
    assert [r["threshold"] for r in rows] == [0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6]
    assert rows[0].asDict().keys() == {"threshold", "precision", "recall", "f1"}
    assert all(a["recall"] >= b["recall"] for a, b in zip(rows, rows[1:]))


def test_threshold_without_positives_predicted(scored):
    rows = evaluation.threshold_table(scored([1, 0], [0.3, 0.2]), [0.25, 0.9]).collect()
    assert tuple(rows[1]) == (0.9, 0.0, 0.0, 0.0)


def test_confusion_matrix_has_all_cells(scored):
    rows = {(r["actual"], r["predicted"]): r["customers"] for r in evaluation.confusion_matrix(scored([1, 0, 0], [0.9, 0.1, 0.5])).collect()}
    assert rows == {(0, 0): 2, (0, 1): 0, (1, 0): 0, (1, 1): 1}


@pytest.mark.parametrize("parts", [1, 9])
def test_curves(scored, parts):
    df = scored([1, 0, 1, 0, 1] * 20, [0.9, 0.8, 0.8, 0.1, 0.05] * 20)
    roc = {r["threshold"]: (r["fpr"], r["tpr"]) for r in evaluation.roc_points(df, parts=parts).collect()}
    assert roc == {
        None: (0.0, 0.0),
        0.9: (0.0, 0.333333),
        0.8: (0.5, 0.666667),
        0.1: (1.0, 0.666667),
        0.05: (1.0, 1.0),
    }
    pr = {r["threshold"]: (r["precision"], r["recall"]) for r in evaluation.precision_recall_points(df, parts=parts).collect()}
    assert pr == {
        None: (1.0, 0.0),
        0.9: (1.0, 0.333333),
        0.8: (0.666667, 0.666667),
        0.1: (0.5, 0.666667),
        0.05: (0.6, 1.0),
    }


def test_report(spark, scored):
    from pyspark.sql import functions as F

    df = scored([1, 0, 1, 0], [0.9, 0.2, 0.4, 0.6]).withColumn("is_test", F.col("CustomerID") >= 2)
    coefficients = spark.createDataFrame([("a", 0.5, 0.5), ("b", -2.0, 2.0)], "feature string, coefficient double, abs_coefficient double")
    row = evaluation.evaluation_report(df, coefficients).first()
    assert (row["train_size"], row["test_size"]) == (2, 2)
    assert row["class_counts"].asDict() == {"train": {"0": 1, "1": 1}, "test": {"0": 1, "1": 1}}
    assert row["default_threshold"] == 0.5
    assert [r["threshold"] for r in row["threshold_analysis"]][:2] == [0.2, 0.25]
    assert [r["feature"] for r in row["feature_coefficients"]] == ["b", "a"]
    assert row["roc_auc"] == 0.0
