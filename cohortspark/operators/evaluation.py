"""Held-out evaluation from label and probability, exact for any number of distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.config import DECISION_THRESHOLD, LABEL, THRESHOLDS
from cohortspark.functions.columns import ratio
from cohortspark.functions.ranking import running_totals

P = "Churn_Probability_Raw"


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def score_totals(scored: DataFrame, label: str = LABEL, p: str = P, parts: int | None = None) -> DataFrame:
    """Per distinct score, descending: positives, negatives and their running totals."""
    totals = {"positives": F.count_if(F.col(label) == 1), "negatives": F.count_if(F.col(label) == 0)}
    return running_totals(scored, p, totals, ascending=False, parts=parts)


def metrics(scored: DataFrame, label: str = LABEL, p: str = P, digits: int = 6, parts: int | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 above 0.5, area under the ROC curve, and average precision.

    All six come from one table of distinct scores. Tied scores count half in the ROC area. Average precision
    is the step sum of precision over recall gained. Undefined areas are null.
    """
    per_score = score_totals(scored, label, p, parts)
    above = F.col(p) > DECISION_THRESHOLD
    counted = per_score.agg(
        F.sum("positives").alias("pos"),
        F.sum("negatives").alias("neg"),
        F.coalesce(F.sum(F.when(above, F.col("positives"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(above, F.col("negatives"))), F.lit(0)).alias("fp"),
        F.sum(F.col("negatives") * (F.col("cum_positives") - F.col("positives") / 2.0)).alias("won"),
        F.sum(F.col("positives") * (F.col("cum_positives") / (F.col("cum_positives") + F.col("cum_negatives")))).alias("ap"),
    )
    pos, neg, tp, fp = (F.col(c) for c in ("pos", "neg", "tp", "fp"))
    values = {
        "accuracy": ratio(tp + neg - fp, pos + neg),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, pos),
        "f1": _f1(tp, fp, pos - tp),
        "roc_auc": F.try_divide(F.col("won"), pos.cast("double") * neg.cast("double")),
        "pr_auc": F.try_divide(F.col("ap"), pos.cast("double")),
    }
    return counted.select(*[F.round(v, digits).alias(k) for k, v in values.items()])


def threshold_table(
    scored: DataFrame, thresholds: list[float] | None = None, label: str = LABEL, p: str = P, digits: int = 6
) -> DataFrame:
    """Precision, recall and F1 with scores at or above each threshold called positive, in one pass."""
    thresholds = THRESHOLDS if thresholds is None else thresholds
    positive = F.col(label) == 1
    counted = scored.agg(
        F.count_if(positive).alias("pos"),
        *[F.count_if(positive & (F.col(p) >= t)).alias(f"tp{i}") for i, t in enumerate(thresholds)],
        *[F.count_if(~positive & (F.col(p) >= t)).alias(f"fp{i}") for i, t in enumerate(thresholds)],
    )
    rows = []
    for i, t in enumerate(thresholds):
        tp, fp, pos = F.col(f"tp{i}"), F.col(f"fp{i}"), F.col("pos")
        rows.append(
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.round(ratio(tp, tp + fp), digits).alias("precision"),
                F.round(ratio(tp, pos), digits).alias("recall"),
                F.round(_f1(tp, fp, pos - tp), digits).alias("f1"),
            )
        )
    return counted.select(F.inline(F.array(*rows)))


def confusion_matrix(scored: DataFrame, label: str = LABEL, p: str = P) -> DataFrame:
    """All four cells, empty ones as 0."""
    above = F.col(p) > DECISION_THRESHOLD
    cells = [(a, c) for a in (0, 1) for c in (0, 1)]
    counted = scored.agg(
        *[F.count_if((F.col(label) == a) & (above if c else ~above)).alias(f"n{a}{c}") for a, c in cells]
    )
    rows = [
        F.struct(F.lit(a).alias("actual"), F.lit(c).alias("predicted"), F.col(f"n{a}{c}").alias("customers"))
        for a, c in cells
    ]
    return counted.select(F.inline(F.array(*rows)))


def _class_totals(scored: DataFrame, label: str) -> tuple[int, int]:
    row = scored.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).first()
    return row["pos"], row["neg"]


def roc_points(scored: DataFrame, label: str = LABEL, p: str = P, digits: int = 6, parts: int | None = None) -> DataFrame:
    """One point per distinct score, and the origin, which has no threshold."""
    pos, neg = _class_totals(scored, label)
    points = score_totals(scored, label, p, parts).select(
        F.round(ratio(F.col("cum_negatives"), F.lit(neg)), digits).alias("fpr"),
        F.round(ratio(F.col("cum_positives"), F.lit(pos)), digits).alias("tpr"),
        F.col(p).alias("threshold"),
    )
    origin = scored.sparkSession.createDataFrame([(0.0, 0.0, None)], points.schema)
    return points.unionByName(origin)


def precision_recall_points(
    scored: DataFrame, label: str = LABEL, p: str = P, digits: int = 6, parts: int | None = None
) -> DataFrame:
    """One point per distinct score, and the closing point at recall 0 and precision 1."""
    pos, _ = _class_totals(scored, label)
    caught, missed = F.col("cum_positives"), F.col("cum_negatives")
    points = score_totals(scored, label, p, parts).select(
        F.round(ratio(caught, caught + missed), digits).alias("precision"),
        F.round(ratio(caught, F.lit(pos)), digits).alias("recall"),
        F.col(p).alias("threshold"),
    )
    closing = scored.sparkSession.createDataFrame([(1.0, 0.0, None)], points.schema)
    return points.unionByName(closing)


def evaluation_report(split_scored: DataFrame, coefficients: DataFrame, digits: int = 6) -> DataFrame:
    """One row: sizes, class counts per split, six metrics, threshold table and coefficients.

    `split_scored` holds all modelled customers with `is_test`; metrics use the test rows.
    """
    test = split_scored.filter("is_test")

    def rows(test_side: bool, label: int | None = None) -> Column:
        side = F.col("is_test") if test_side else ~F.col("is_test")
        return F.count_if(side if label is None else side & (F.col(LABEL) == label))

    def classes(test_side: bool) -> Column:
        return F.create_map(F.lit("0"), rows(test_side, 0), F.lit("1"), rows(test_side, 1))

    sizes = split_scored.agg(
        rows(False).alias("train_size"),
        rows(True).alias("test_size"),
        F.struct(classes(False).alias("train"), classes(True).alias("test")).alias("class_counts"),
    )
    # Nine thresholds and nine predictors: arrays of fixed length.
    table = threshold_table(test, digits=digits)
    thresholds = table.agg(F.array_sort(F.collect_list(F.struct(*table.columns))).alias("x"))
    entry = F.struct(
        (-F.col("abs_coefficient")).alias("_order"),
        "feature",
        F.round("coefficient", digits).alias("coefficient"),
        F.round("abs_coefficient", digits).alias("abs_coefficient"),
    )
    ordered = coefficients.agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("_order")).alias("x")
    )
    measured = metrics(test, digits=digits)
    return (
        sizes.withColumn("_m", measured.select(F.struct(*measured.columns)).scalar())
        .select("train_size", "test_size", "class_counts", "_m.*")
        .withColumn("default_threshold", F.lit(DECISION_THRESHOLD))
        .withColumn("threshold_analysis", thresholds.scalar())
        .withColumn("feature_coefficients", ordered.scalar())
    )


def flat_report(report: DataFrame) -> DataFrame:
    """(path, number, text): every value of a nested report as a row, whatever its shape.

    A path joins the names of fields and the keys of maps by dots; elements of arrays are counted from 0 in brackets.
    Numbers and truth values are in `number`, all else in `text`; a missing value has neither.
    """

    def leaf(path: Column, value: Column, kind: T.DataType) -> Column:
        counts = isinstance(kind, (T.NumericType, T.BooleanType))
        number = value.cast("int").cast("double") if isinstance(kind, T.BooleanType) else value.cast("double") if counts else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if counts else value.cast("string")
        return F.array(F.struct(path.alias("path"), number.alias("number"), text.alias("text")))

    def rows(path: Column, value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.concat(*[rows(F.concat(path, F.lit(f".{f.name}")), value[f.name], f.dataType) for f in kind])
        if isinstance(kind, T.ArrayType):
            each = lambda x, i: rows(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), x, kind.elementType)
            return F.flatten(F.transform(value, each))
        if isinstance(kind, T.MapType):
            each = lambda e: rows(F.concat(path, F.lit("."), e["key"].cast("string")), e["value"], kind.valueType)
            return F.flatten(F.transform(F.map_entries(value), each))
        return leaf(path, value, kind)

    parts = [rows(F.lit(f.name), F.col(f.name), f.dataType) for f in report.schema]
    return report.select(F.explode(F.concat(*parts)).alias("row")).select("row.*")
