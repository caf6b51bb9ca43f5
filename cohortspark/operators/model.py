"""Stratified split, weighted logistic regression on standardised predictors, scoring, persistence."""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.config import DECISION_THRESHOLD, LABEL, PREDICTORS, SEED, TEST_SHARE
from cohortspark.functions.quantiles import column_sizes, order_statistics
from cohortspark.operators.insights import coefficient_direction
from cohortspark.sources.tables import check_columns

WEIGHT = "_weight"
# Strength of the quadratic penalty: the loss is summed over rows and weighted by this.
INVERSE_PENALTY = 1.0

# Published standardised coefficients of the original study.
PUBLISHED_COEFFICIENTS = {
    "Recency": 0.13199,
    "Frequency": -0.774142,
    "Monetary": 0.374441,
    "AvgOrderValue": -0.002792,
    "UniqueProducts": -0.41015,
    "TotalItems": -0.768869,
    "ActiveMonths": -0.789998,
    "TenureDays": 0.122682,
    "PurchaseSpanDays": 0.006174,
}


def model_rows(features: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Id, predictors and label, joined when the label comes separately; rows with a gap are left out."""
    if labels is not None:
        features = features.drop(LABEL).join(labels.select("CustomerID", LABEL), "CustomerID", "inner")
    return features.select("CustomerID", *PREDICTORS, LABEL).dropna(subset=[*PREDICTORS, LABEL])


def split_key(seed: int = SEED) -> Column:
    """60 bits of a hash of id and seed: a fixed, evenly spread order of customers."""
    text = F.concat(F.col("CustomerID").cast("string"), F.lit(f"-{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def test_sizes(class_counts: list[int], share: float = TEST_SHARE) -> list[int]:
    """Rows per class in a test set of ceil(share * rows), class shares kept by largest remainder."""
    rows = sum(class_counts)
    wanted = ceil(share * rows)
    exact = [wanted * n / rows if rows else 0 for n in class_counts]
    sizes = [int(x) for x in exact]
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i] - exact[i], i))[: wanted - sum(sizes)]:
        sizes[i] += 1
    return sizes


test_sizes.__test__ = False


def with_split(rows: DataFrame, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Adds `is_test`. Each class gives the rows with the lowest split keys; two cut values decide, no sort."""
    keyed = rows.withColumn("_key", split_key(seed))
    by_class = keyed.select(*[F.when(F.col(LABEL) == c, F.col("_key")).alias(f"k{c}") for c in (0, 1)])
    sizes = column_sizes(by_class, ["k0", "k1"])
    wanted = test_sizes([sizes["k0"], sizes["k1"]], share)
    ranks = {f"k{c}": [n - 1] for c, n in enumerate(wanted) if n > 0}
    cuts = order_statistics(by_class, ranks, sizes) if ranks else {}
    is_test = F.lit(False)
    for c, n in enumerate(wanted):
        if n > 0:
            is_test = is_test | ((F.col(LABEL) == c) & (F.col("_key") <= F.lit(cuts[f"k{c}"][n - 1][0])))
    return keyed.withColumn("is_test", is_test).drop("_key")


def class_counts(rows: DataFrame) -> dict[int, int]:
    counts = rows.agg(F.count_if(F.col(LABEL) == 0).alias("n0"), F.count_if(F.col(LABEL) == 1).alias("n1")).first()
    return {0: counts["n0"], 1: counts["n1"]}


def class_weights(counts: dict[int, int]) -> dict[int, float]:
    """Balanced weights rows / (2 * rows of the class)."""
    if not all(counts.values()):
        raise ValueError(f"training needs rows of both classes, found {counts}")
    return {c: sum(counts.values()) / (2 * n) for c, n in counts.items()}


def with_weight(rows: DataFrame, weights: dict[int, float]) -> DataFrame:
    return rows.withColumn(WEIGHT, F.when(F.col(LABEL) == 1, F.lit(weights[1])).otherwise(F.lit(weights[0])))


def build_pipeline(rows: int) -> Pipeline:
    """Unfitted pipeline for a training set of `rows` rows.

    The scaler divides by the sample deviation; the product turns that into the population deviation. The
    penalty of the summed loss, 1/2 |w|^2 with weight 1, is 1/rows when the loss is averaged, as the balanced
    weights add up to the number of rows. The intercept is not penalised.
    """
    correction = sqrt(rows / (rows - 1))
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=PREDICTORS, outputCol="_assembled"),
            StandardScaler(inputCol="_assembled", outputCol="_scaled", withMean=True, withStd=True),
            ElementwiseProduct(
                inputCol="_scaled", outputCol="_standardised", scalingVec=Vectors.dense([correction] * len(PREDICTORS))
            ),
            LogisticRegression(
                featuresCol="_standardised",
                labelCol=LABEL,
                weightCol=WEIGHT,
                probabilityCol="_probability",
                rawPredictionCol="_raw",
                predictionCol="_prediction",
                regParam=1.0 / (INVERSE_PENALTY * rows),
                elasticNetParam=0.0,
                standardization=False,
                maxIter=1000,
                tol=1e-7,
            ),
        ]
    )


def train(rows: DataFrame, pipeline: Pipeline | None = None) -> PipelineModel:
    """Fit on the given rows only."""
    counts = class_counts(rows)
    return (pipeline or build_pipeline(sum(counts.values()))).fit(with_weight(rows, class_weights(counts)))


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Adds Churn_Probability_Raw, the probability of class 1."""
    check_columns(features, PREDICTORS)
    scored = model.transform(features).withColumn("Churn_Probability_Raw", vector_to_array("_probability")[1])
    return scored.select(*features.columns, "Churn_Probability_Raw")


def decide(probability: str = "Churn_Probability_Raw", threshold: float = DECISION_THRESHOLD) -> Column:
    """Class 1 above the threshold; exactly at it is class 0."""
    return F.when(F.col(probability) > threshold, 1).otherwise(0)


def published_score(features: DataFrame, digits: int = 9) -> DataFrame:
    """Adds Churn_Probability_Raw from the published coefficients on predictors standardised over these rows."""
    stats = features.agg(
        *[F.avg(c).alias(f"m_{c}") for c in PREDICTORS], *[F.stddev_pop(c).alias(f"s_{c}") for c in PREDICTORS]
    ).first()
    return features.withColumn(
        "Churn_Probability_Raw",
        linear_probability(
            {c: (k, stats[f"m_{c}"], stats[f"s_{c}"] or 1.0) for c, k in PUBLISHED_COEFFICIENTS.items()}, 0.0, digits
        ),
    )


def linear_probability(terms: dict[str, tuple[float, float, float]], intercept: float, digits: int | None = None) -> Column:
    """Logistic function of intercept + sum of coefficient * (column - mean) / deviation."""
    total = F.lit(float(intercept))
    for c, (coefficient, mean, deviation) in terms.items():
        total = total + F.lit(coefficient) * ((F.col(c) - F.lit(mean)) / F.lit(deviation))
    p = 1.0 / (1.0 + F.exp(-total))
    return p if digits is None else F.round(p, digits)


def coefficient_table(model: PipelineModel, spark) -> DataFrame:
    """Standardised coefficients by magnitude, with the direction of the association."""
    pairs = list(zip(PREDICTORS, [float(c) for c in model.stages[-1].coefficients]))
    table = spark.createDataFrame(pairs, "feature string, coefficient double")
    return (
        table.withColumn("abs_coefficient", F.abs("coefficient"))
        .withColumn("direction", coefficient_direction())
        .orderBy(F.col("abs_coefficient").desc(), "feature")
    )


def strongest(coefficients: DataFrame, k: int = 3) -> DataFrame:
    """The k largest coefficients of either sign, in one small table."""
    positive = coefficients.filter("coefficient > 0").orderBy(F.col("coefficient").desc(), "feature").limit(k)
    negative = coefficients.filter("coefficient < 0").orderBy(F.col("coefficient").asc(), "feature").limit(k)
    return positive.unionByName(negative)


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    try:
        return PipelineModel.load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            raise FileNotFoundError(f"model not found at '{path}'") from error
        raise
