import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F
from sample import SF_DIR

from cohortspark.config import PREDICTORS
from cohortspark.operators import evaluation, model, weights
from cohortspark.plans.catalog import order_pipeline

LOAD = """
import json, sys
from cohortspark.session import local_session
from cohortspark.operators import weights
spark = local_session(2, "second")
found = weights.score(weights.load_weights(spark, sys.argv[1]), spark.read.parquet(sys.argv[2]))
print("ROWS " + json.dumps(sorted([r.CustomerID, r.Churn_Probability_Raw] for r in found.collect())))
spark.stop()
"""


@pytest.fixture(scope="module")
def rows(spark):
    """Training rows with a predictor that is the sum of two others, and one without spread."""
    some = np.random.default_rng(4)
    data = []
    for i in range(400):
        x = [float(v) for v in some.normal(0, 1, len(PREDICTORS) - 2)]
        label = int(some.random() < 1 / (1 + np.exp(-(x[0] - 0.5 * x[1]))))
        data.append((i, *x, x[0] + x[1], 2.0, label))
    columns = ", ".join(f"{c} double" for c in PREDICTORS)
    return spark.createDataFrame(data, f"CustomerID bigint, {columns}, Churn_90D int")


def plain_fit(rows):
    data = rows.orderBy("CustomerID").collect()
    x, y = np.array([[r[c] for c in PREDICTORS] for r in data]), np.array([r["Churn_90D"] for r in data], float)
    spread = x.std(axis=0)
    z = np.column_stack([(x - x.mean(axis=0)) / np.where(spread == 0, 1, spread), np.ones(len(x))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    b, penalty = np.zeros(z.shape[1]), np.append(np.ones(len(PREDICTORS)), 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z.T * (w * p * (1 - p))) @ z + np.diag(penalty), z.T @ (w * (p - y)) + penalty * b)
    return b


@pytest.fixture(scope="module")
def table(rows):
    return weights.fitted(rows)


def test_weights_are_the_optimum(rows, table):
    found = [r.coefficient for r in sorted(table.collect(), key=lambda r: r.position)]
    assert np.abs(np.array(found) - plain_fit(rows)).max() < 1e-10


def test_another_start_and_layout_end_at_the_same_place(rows, table):
    again = weights.weight_table(rows.sparkSession, *weights.polish(rows.repartition(7), start=plain_fit(rows) + 0.05))
    assert again.first().version == table.first().version


def test_too_few_passes_are_an_error(rows):
    with pytest.raises(ArithmeticError):
        weights.polish(rows, passes=1)


def test_the_scores_are_those_of_the_weights(rows, table):
    b = plain_fit(rows)
    scored = {r.CustomerID: r.Churn_Probability_Raw for r in weights.score(table, rows).collect()}
    stats = weights.moments(rows)
    for r in rows.limit(20).collect():
        total = b[-1] + sum(b[i] * (r[c] - stats[i][0]) / stats[i][1] for i, c in enumerate(PREDICTORS))
        assert scored[r.CustomerID] == pytest.approx(1 / (1 + np.exp(-total)), abs=2e-9)
    with pytest.raises(ValueError, match="Recency"):
        weights.score(table, rows.drop("Recency"))


def test_the_pipeline_model_is_close_to_its_weights(spark):
    p = order_pipeline(spark, SF_DIR)
    fitted = [float(c) for c in p.model().stages[-1].coefficients]
    found = {r.feature: r.coefficient for r in p.weights().collect()}
    assert max(abs(found[c] - k) for c, k in zip(PREDICTORS, fitted)) < 1e-2
    assert {r.feature for r in model.strongest(weights.coefficients(p.weights())).collect()} <= set(PREDICTORS)


def test_versions(spark, table, tmp_path):
    path = str(tmp_path / "w")
    with pytest.raises(FileNotFoundError):
        weights.load_weights(spark, path)
    first = table
    second = weights.weight_table(spark, [(0.0, 1.0)] * len(PREDICTORS), [0.5] * (len(PREDICTORS) + 1))
    a = weights.save_weights(first, path)
    assert sorted(weights.load_weights(spark, path).collect()) == sorted(first.collect())
    b = weights.save_weights(second, path)
    assert a != b and weights.save_weights(first, path) == a
    assert sorted(weights.load_weights(spark, path, b).collect()) == sorted(second.collect())
    with pytest.raises(ValueError, match="several versions"):
        weights.load_weights(spark, path)
    with pytest.raises(FileNotFoundError):
        weights.load_weights(spark, path, "none")


def test_another_process_gives_the_same_scores(spark, rows, table, tmp_path):
    weights.save_weights(table, str(tmp_path / "w"))
    rows.write.parquet(str(tmp_path / "rows"))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run(
        [sys.executable, "-c", LOAD, str(tmp_path / "w"), str(tmp_path / "rows")],
        capture_output=True, text=True, timeout=150, cwd=root, env=os.environ | {"PYTHONPATH": root}, check=True,
    )
    there = json.loads(next(x for x in out.stdout.splitlines() if x.startswith("ROWS "))[5:])
    here = sorted([r.CustomerID, r.Churn_Probability_Raw] for r in weights.score(table, rows).collect())
    assert there == here and len(here) == 400


def test_every_value_of_a_nested_report_is_a_row(spark):
    kind = "a int, b struct<c: double, d: map<string, array<boolean>>>, e array<struct<f: string, g: bigint>>, h array<int>"
    report = spark.createDataFrame([(1, (None, {"x": [True, False]}), [("s", 5), (None, None)], [])], kind)
    assert {tuple(r) for r in evaluation.flat_report(report).collect()} == {
        ("a", 1.0, None), ("b.c", None, None), ("b.d.x[0]", 1.0, None), ("b.d.x[1]", 0.0, None),
        ("e[0].f", None, "s"), ("e[0].g", 5.0, None), ("e[1].f", None, None), ("e[1].g", None, None),
    }
    assert evaluation.flat_report(report.select(F.lit("t").alias("only"))).collect()[0].text == "t"
