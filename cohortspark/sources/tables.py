"""Readers and writers of the interchange tables (Parquet or CSV) and JSON reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.config import EXPECTED_COLUMNS, FEATURE_COLUMNS, LABEL, PREDICTORS, QUALIFIED_COLUMNS, Windows
from cohortspark.functions.columns import up_to
from cohortspark.schemas import FEATURES, QUALIFIED, RAW
from cohortspark.sources.csvlines import OPTIONS, read_csv

# The columns of the table of predictions.
TEST_PREDICTION_COLUMNS = ["CustomerID", LABEL, "Churn_Probability", "Predicted_Class"] + PREDICTORS


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    present = set(df.columns)
    return [c for c in required if c not in present]


def check_columns(df: DataFrame, required: list[str] = EXPECTED_COLUMNS, exact: bool = False) -> DataFrame:
    """Raise when a required column is absent; extra columns pass unless `exact`."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"the table lacks {missing}; it has {df.columns}")
    if exact and df.columns != list(required):
        raise ValueError(f"columns are {df.columns}, expected exactly {list(required)}")
    return df


def lenient_timestamp(column: str) -> F.Column:
    """Text to timestamp without zone: ISO dates, and month/day/year with or without a time. Others become null."""
    iso = F.regexp_replace(F.trim(column), r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2")
    iso = F.regexp_replace(iso, r"^(\d{4}-\d{1,2}-\d{1,2})[ T](\d{1,2}:\d{2})$", "$1 $2:00")
    return iso.try_cast("timestamp_ntz")


def _converted(column: str, kind: T.DataType, found: T.DataType) -> F.Column:
    """A column in its declared type. Empty text and not-a-number are null; what else does not fit is an error."""
    value = F.col(column)
    if isinstance(found, T.StringType) and not isinstance(kind, T.StringType):
        value = F.when(F.trim(value) != "", F.trim(value))
        value = F.when(~F.lower(value).isin("nan", "null", "none"), value)
    if isinstance(found, (T.FloatType, T.DoubleType)):
        value = F.when(~F.isnan(value), value)
    if isinstance(kind, (T.LongType, T.IntegerType)) and not isinstance(found, (T.LongType, T.IntegerType)):
        number = value.cast("decimal(38,6)")  # an id written as a decimal number, 17850.0, is the whole number 17850
        wrong = F.raise_error(F.concat(F.lit(f"{column} is not a whole number: "), value.cast("string")))
        return F.when(number == F.floor(number), number.cast(kind)).when(value.isNotNull(), wrong.cast(kind))
    return value.cast(kind)


def _normalised(df: DataFrame, schema: T.StructType, lenient: Sequence[str] = ()) -> DataFrame:
    """The schema's columns, found by name and in their types, then the others as they are."""
    kinds = {f.name: f.dataType for f in schema.fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            (lenient_timestamp(c) if c in lenient and isinstance(have[c], T.StringType) else _converted(c, kinds[c], have[c])).alias(c)
            if c in kinds and kinds[c] != T.StringType() and (kinds[c] != have[c] or isinstance(have[c], T.DoubleType))
            else F.col(c).cast(kinds.get(c, have[c])).alias(c)
            for c in df.columns
        ]
    )


def _read(spark: SparkSession, path: str, fmt: str, multi_line: bool) -> DataFrame:
    """CSV columns as text, by many tasks; without `multi_line` each line is taken for a record, which saves a scan."""
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    if multi_line:
        return read_csv(spark, path)
    return spark.read.option("header", True).option("inferSchema", False).options(**OPTIONS).csv(path)


def open_table(path: str, what: str, load):
    """What load gives; a path that is not there is a FileNotFoundError that names what was looked for."""
    try:
        return load()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            raise FileNotFoundError(f"{what} not found at '{path}'") from error
        raise


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = True) -> DataFrame:
    """Raw invoice lines in the declared types, whatever the file has. A missing column is an error, as is a number
    that is none; a date that is none becomes null, and the audit counts it."""
    found = check_columns(open_table(path, "raw transactions", lambda: _read(spark, path, fmt, multi_line)))
    return _normalised(found, RAW, ["InvoiceDate"])


def read_qualified(spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = True) -> DataFrame:
    """Qualified lines by name; columns that the file lacks are null, but the ids, dates and amounts must be there."""
    found = open_table(path, "qualified transactions", lambda: _read(spark, path, fmt, multi_line))
    return _declared(found, QUALIFIED, ["InvoiceNo", "InvoiceDate", "CustomerID"])


def _declared(found: DataFrame, schema: T.StructType, required: list[str]) -> DataFrame:
    if found.columns == schema.names and [f.dataType for f in found.schema] == [f.dataType for f in schema]:
        return found
    check_columns(found, required)
    normal = _normalised(found, schema, [f.name for f in schema if isinstance(f.dataType, T.TimestampNTZType)])
    missing = F.lit(None)
    return normal.select(*[F.col(f.name) if f.name in found.columns else missing.cast(f.dataType).alias(f.name) for f in schema])


def write_qualified(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Keep those of the ten columns that are present, in their fixed order."""
    _write(df.select(*[c for c in QUALIFIED_COLUMNS if c in df.columns]), path, fmt)
    return path


def read_features(spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = True) -> DataFrame:
    """The customer table by name, in the declared types; columns that the file lacks are null."""
    found = open_table(path, "customer features", lambda: _read(spark, path, fmt, multi_line))
    return _declared(found, FEATURES, ["CustomerID"])


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Only the canonical columns are written; anything about the label window stays out."""
    _write(df.select(*[c for c in FEATURE_COLUMNS if c in df.columns]), path, fmt)
    return path


def write_test_predictions(scored: DataFrame, path: str, fmt: str = "parquet") -> str:
    _write(test_predictions(scored), path, fmt)
    return path


def test_predictions(scored: DataFrame) -> DataFrame:
    """Held-out rows with the probability on the 0-1 scale and the class decided at more than 0.5."""
    return scored.select(*TEST_PREDICTION_COLUMNS)


test_predictions.__test__ = False


def transactions_for_trends(qualified: DataFrame, windows: Windows) -> DataFrame:
    """Lines up to the snapshot only, so no report can show the label window."""
    return qualified.filter(up_to(windows.snapshot))


def write_report(report: DataFrame, path: str) -> str:
    """A report of one row as JSON. The row is an aggregate, so one output file is enough."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def read_report(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """A JSON report, or None when it has not been written yet."""
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            return None
        raise


def _write(df: DataFrame, path: str, fmt: str) -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
