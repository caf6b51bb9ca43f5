import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.config import LABEL, PREDICTORS
from cohortspark.operators import checks, model


@pytest.fixture(scope="module")
def customers(spark):
    """Seeded customers whose label depends on some predictors; recency + span = tenure, as in real data."""
    rng = np.random.default_rng(7)
    n = 500
    recency, span = rng.integers(0, 200, n), rng.integers(30, 400, n)
    columns = {
        "CustomerID": np.arange(1, n + 1),
        "Recency": recency,
        "Frequency": rng.integers(2, 30, n),
        "Monetary": rng.lognormal(6, 1, n),
        "AvgOrderValue": rng.lognormal(4, 1, n),
        "UniqueProducts": rng.integers(1, 90, n),
        "TotalItems": rng.integers(1, 2000, n),
        "ActiveMonths": rng.integers(1, 12, n),
        "TenureDays": recency + span,
        "PurchaseSpanDays": span,
    }
    columns[LABEL] = (rng.random(n) < 1 / (1 + np.exp(-(recency - 100) / 40 - 0.4))).astype(int)
    rows = list(zip(*[c.tolist() for c in columns.values()]))
    doubles = {"Monetary", "AvgOrderValue"}
    schema = ", ".join(f"{c} {'double' if c in doubles else 'int' if c == LABEL else 'bigint'}" for c in columns)
    return spark.createDataFrame(rows, schema).cache()


def newton(x, y):
    """Minimise 1/2 |w|^2 + sum of balanced log losses by Newton steps."""
    n = len(y)
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(n)]
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    w, penalty = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        gradient = z.T @ (weight * (p - y)) + penalty @ w
        w -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, gradient)
    return w, 1 / (1 + np.exp(-z @ w))


def probabilities(df):
    return {r["CustomerID"]: r["Churn_Probability_Raw"] for r in df.select("CustomerID", "Churn_Probability_Raw").collect()}


def test_fit_equals_the_penalised_weighted_objective(spark, customers):
    fitted = model.train(customers)
    rows = customers.orderBy("CustomerID").toPandas()
    w, p = newton(rows[PREDICTORS].to_numpy(float), rows[LABEL].to_numpy(float))
    got = probabilities(model.score(fitted, customers))
    assert np.abs(np.array([got[i] for i in rows["CustomerID"]]) - p).max() < 1e-5
    assert np.abs(np.array(fitted.stages[-1].coefficients) - w[:-1]).max() < 1e-3
    table = model.coefficient_table(fitted, spark).collect()
    assert [r["abs_coefficient"] for r in table] == sorted((r["abs_coefficient"] for r in table), reverse=True)
    assert {r["feature"] for r in table} == set(PREDICTORS)


def test_scaler_sees_training_rows_only(customers):
    part = customers.filter("CustomerID <= 250")
    scaler = model.train(part).stages[1]
    assert abs(scaler.mean[0] - part.agg(F.avg("Recency")).first()[0]) < 1e-9


def test_probabilities_and_classes(customers):
    scored = model.score(model.train(customers), customers).withColumn("c", model.decide())
    assert scored.filter("Churn_Probability_Raw < 0 OR Churn_Probability_Raw > 1").isEmpty()
    assert scored.filter("(c = 1) != (Churn_Probability_Raw > 0.5)").isEmpty()


def test_class_is_decided_above_one_half(spark):
    df = spark.createDataFrame([(0.5,), (0.500001,)], "Churn_Probability_Raw double")
    assert [r[0] for r in df.select(model.decide()).collect()] == [0, 1]


def test_reloaded_model_gives_the_same_probabilities(customers, tmp_path):
    fitted = model.train(customers)
    path = model.save_model(fitted, str(tmp_path / "model"))
    first, second = probabilities(model.score(fitted, customers)), probabilities(model.score(model.load_model(path), customers))
    assert all(abs(first[k] - second[k]) <= 1e-12 for k in first)


def test_missing_model(tmp_path):
    with pytest.raises(FileNotFoundError):
        model.load_model(str(tmp_path / "none"))


def test_missing_predictors_are_named(customers):
    with pytest.raises(ValueError, match="Recency"):
        model.score(model.train(customers), customers.drop("Recency"))


def test_one_class_cannot_be_trained(customers):
    with pytest.raises(ValueError, match="both classes"):
        model.train(customers.filter(f"{LABEL} = 1"))


def test_split_keeps_shares_and_is_repeatable(customers):
    split = model.with_split(model.model_rows(customers))
    counts = {(r["is_test"], r[LABEL]): r["count"] for r in split.groupBy("is_test", LABEL).count().collect()}
    total = {c: counts[(True, c)] + counts[(False, c)] for c in (0, 1)}
    assert counts[(True, 0)] + counts[(True, 1)] == 100 and split.count() == 500
    assert all(abs(counts[(True, c)] - 0.2 * total[c]) < 1 for c in (0, 1))
    again = model.with_split(model.model_rows(customers.repartition(7)))
    assert split.select("CustomerID", "is_test").exceptAll(again.select("CustomerID", "is_test")).isEmpty()
    other = model.with_split(model.model_rows(customers), seed=1)
    assert not split.select("CustomerID", "is_test").exceptAll(other.select("CustomerID", "is_test")).isEmpty()


def test_no_customer_on_both_sides(customers):
    assert checks.split_overlap(model.with_split(customers)).first()[0] == 0


def test_sizes_of_the_published_study():
    assert model.test_sizes([1275, 490]) == [255, 98]
    assert model.test_sizes([3, 3]) == [1, 1]
    assert model.test_sizes([4, 2]) == [1, 1]
    assert model.test_sizes([0, 0]) == [0, 0]


def test_rows_with_gaps_are_left_out(customers):
    holed = customers.withColumn("Monetary", F.when(F.col("CustomerID") > 10, F.col("Monetary")))
    assert model.model_rows(holed).count() == 490
    labels = customers.filter("CustomerID <= 400").select("CustomerID", LABEL)
    assert model.model_rows(holed, labels).count() == 390


def test_balanced_weights():
    assert model.class_weights({0: 75, 1: 25}) == {0: 100 / 150, 1: 2.0}


def test_linear_probability(spark):
    df = spark.createDataFrame([(3.0, 1.0)], "a double, b double")
    p = df.select(model.linear_probability({"a": (2.0, 1.0, 4.0), "b": (-1.0, 0.0, 1.0)}, 0.5)).first()[0]
    assert abs(p - 1 / (1 + np.exp(-0.5))) < 1e-15


def test_strongest_coefficients(spark):
    table = spark.createDataFrame([(c, v) for c, v in zip("abcde", [3.0, -1.0, 2.0, 1.0, 0.5])], "feature string, coefficient double")
    assert [r["feature"] for r in model.strongest(table, 3).collect()] == ["a", "c", "d", "b"]
