"""The fitted regression as a table of weights: polished, kept by version, and applied in SQL.

An iterative fit stops near the optimum, at a place that depends on how rows were dealt out. A few Newton steps from
there end at the optimum itself, so equal rows give equal weights at all digits shown. A step is one pass over the
training rows: 66 sums, whose number does not depend on the data, and a system of ten equations on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.config import LABEL, PREDICTORS
from cohortspark.operators.insights import coefficient_direction
from cohortspark.operators.model import INVERSE_PENALTY, class_counts, class_weights
from cohortspark.sources.tables import check_columns, open_table

SCHEMA = "version string, position int, feature string, mean double, deviation double, coefficient double"
INTERCEPT = "(intercept)"


def moments(rows: DataFrame, predictors: Sequence[str] = PREDICTORS) -> list[tuple[float, float]]:
    """Mean and population deviation of each predictor; a predictor without spread has deviation 1."""
    stats = rows.agg(*[F.avg(c) for c in predictors], *[F.stddev_pop(c) for c in predictors]).first()
    n = len(predictors)
    return [(float(stats[i]), float(stats[n + i]) or 1.0) for i in range(n)]


def _measured(rows: DataFrame, point: np.ndarray, n: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and second derivatives at a point; the intercept is last and has no penalty."""
    z = [*[F.col(f"z{i}") for i in range(n)], F.lit(1.0)]
    eta = F.lit(float(point[n]))
    for i in range(n):
        eta = eta + F.lit(float(point[i])) * z[i]
    scored = rows.withColumn("eta", eta).withColumn("p", 1.0 / (1.0 + F.exp(-F.col("eta"))))
    w, y, p = F.col("w"), F.col("y"), F.col("p")
    loss = w * (F.log1p(F.exp(-F.abs("eta"))) + F.greatest("eta", F.lit(0.0)) - y * F.col("eta"))
    first = [F.sum(w * (p - y) * z[i]) for i in range(n + 1)]
    pairs = [(i, j) for i in range(n + 1) for j in range(i, n + 1)]
    second = [F.sum(w * p * (1.0 - p) * z[i] * z[j]) for i, j in pairs]
    found = scored.agg(*[c.alias(f"s{k}") for k, c in enumerate([F.sum(loss), *first, *second])]).first()
    penalty = 1.0 / INVERSE_PENALTY
    gradient = np.array(found[1 : n + 2], float)
    hessian = np.zeros((n + 1, n + 1))
    for (i, j), value in zip(pairs, found[n + 2 :]):
        hessian[i, j] = hessian[j, i] = value
    gradient[:n] += penalty * point[:n]
    hessian[range(n), range(n)] += penalty
    return found[0] + penalty / 2 * float(point[:n] @ point[:n]), gradient, hessian


def polish(
    rows: DataFrame,
    start: Sequence[float] | None = None,
    predictors: Sequence[str] = PREDICTORS,
    passes: int = 60,
    tolerance: float = 1e-9,
) -> tuple[list[tuple[float, float]], list[float]]:
    """(moments, weights): the optimum of the fit's objective on standardised predictors, the intercept last.

    `start` is where an earlier fit ended; without it the steps begin at zero. A step that makes the loss larger is
    halved. The last step taken is smaller than the tolerance, and what is left is its square.
    """
    counts = class_counts(rows)
    by_class = class_weights(counts)
    scale, n = moments(rows, predictors), len(predictors)
    spread = [((F.col(c) - F.lit(m)) / F.lit(d)).alias(f"z{i}") for i, (c, (m, d)) in enumerate(zip(predictors, scale))]
    weight: Column = F.when(F.col(LABEL) == 1, F.lit(by_class[1])).otherwise(F.lit(by_class[0])).alias("w")
    ready = rows.select(*spread, F.col(LABEL).cast("double").alias("y"), weight)
    last = point = np.array(start if start is not None else [0.0] * (n + 1), float)
    step, best = np.zeros(n + 1), np.inf
    for _ in range(passes):
        loss, gradient, hessian = _measured(ready, point, n)
        if loss > best + 1e-9 * abs(best):
            step = step / 2
            point = last + step
            continue
        last, best = point, loss
        step = -np.linalg.solve(hessian, gradient)
        point = last + step
        if np.abs(step).max() <= tolerance:
            return scale, point.tolist()
    raise ArithmeticError(f"no optimum after {passes} passes")


def weight_table(
    spark: SparkSession, scale: Sequence[tuple[float, float]], weights: Sequence[float], predictors: Sequence[str] = PREDICTORS
) -> DataFrame:
    """One row for each predictor, and the intercept; the version is a digest of the numbers at nine digits."""
    rows = [(i, c, *scale[i], weights[i]) for i, c in enumerate(predictors)]
    rows.append((len(rows), INTERCEPT, 0.0, 1.0, weights[-1]))
    shown = "|".join(f"{c}:{m:.9g}:{d:.9g}:{k:.9f}" for _, c, m, d, k in rows)
    version = hashlib.sha1(shown.encode()).hexdigest()[:12]
    return spark.createDataFrame([(version, *r) for r in rows], SCHEMA)


def fitted(rows: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """The table of weights of training rows; a fitted pipeline gives the starting point."""
    start = [*map(float, model.stages[-1].coefficients), float(model.stages[-1].intercept)] if model else None
    return weight_table(rows.sparkSession, *polish(rows, start))


def save_weights(weights: DataFrame, path: str) -> str:
    """Adds the version to the folder, or writes it again; other versions stay. Returns the version."""
    version = weights.select("version").first()["version"]
    out = weights.drop("version").coalesce(1).write.mode("overwrite")
    out.parquet(f"{path}/version={version}")
    return version


def load_weights(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """One version, which may be left out if there is one only. A missing folder or version is an error."""
    found = open_table(path, "model weights", lambda: spark.read.parquet(path))
    found = found.select(F.col("version").cast("string"), *[c for c in found.columns if c != "version"])
    there = [r["version"] for r in found.select("version").distinct().collect()]
    if version is None and len(there) > 1:
        raise ValueError(f"there are several versions: {sorted(there)}")
    if version is not None and version not in there:
        raise FileNotFoundError(f"version {version} not found at '{path}'")
    return found.where(F.col("version") == F.lit(version or there[0]))


def _terms(weights: DataFrame) -> Column:
    """The weights as one map, feature to numbers, for use beside any row. Ten entries."""
    numbers = F.struct("mean", "deviation", "coefficient")
    return weights.agg(F.map_from_entries(F.collect_list(F.struct("feature", numbers)))).scalar()


def score(weights: DataFrame, features: DataFrame, digits: int = 9, predictors: Sequence[str] = PREDICTORS) -> DataFrame:
    """Adds Churn_Probability_Raw, the probability of class 1, from a table of weights."""
    check_columns(features, list(predictors))
    held = features.withColumn("_weights", _terms(weights))
    total = F.col("_weights")[INTERCEPT]["coefficient"]
    for c in predictors:
        term = F.col("_weights")[c]
        total = total + term["coefficient"] * ((F.col(c) - term["mean"]) / term["deviation"])
    scored = held.withColumn("Churn_Probability_Raw", F.round(1.0 / (1.0 + F.exp(-total)), digits))
    return scored.select(*features.columns, "Churn_Probability_Raw")


def coefficients(weights: DataFrame, digits: int = 6) -> DataFrame:
    """Standardised coefficients by magnitude, with the direction of the association."""
    shown = weights.where(F.col("feature") != INTERCEPT).select("feature", F.round("coefficient", digits).alias("coefficient"))
    return (
        shown.withColumn("abs_coefficient", F.abs("coefficient"))
        .withColumn("direction", coefficient_direction())
        .orderBy(F.col("abs_coefficient").desc(), "feature")
    )
