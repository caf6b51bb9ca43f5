import pytest

from cohortspark.config import EXPECTED_COLUMNS, FEATURE_COLUMNS, QUALIFIED_COLUMNS
from cohortspark.operators import checks
from cohortspark.operators.cleaning import clean
from cohortspark.schemas import QUALIFIED, RAW
from cohortspark.sources import tables


def test_missing_columns_are_named_and_extra_ones_pass(raw_lines):
    df = raw_lines({})
    with pytest.raises(ValueError, match="Country"):
        tables.check_columns(df.drop("Country"))
    tables.check_columns(df.withColumnRenamed("Country", "Country").selectExpr("*", "1 AS extra"))
    with pytest.raises(ValueError):
        tables.check_columns(df.selectExpr("*", "1 AS extra"), exact=True)
    assert tables.missing_columns(df.drop("Country", "Quantity"), EXPECTED_COLUMNS) == ["Quantity", "Country"]


@pytest.mark.parametrize("read", [tables.read_raw, tables.read_qualified, tables.read_features])
def test_missing_input(spark, tmp_path, read):
    with pytest.raises(FileNotFoundError):
        read(spark, str(tmp_path / "none"))


def test_raw_csv_is_typed_and_dates_are_lenient(spark, tmp_path):
    path = tmp_path / "raw"
    path.mkdir()
    (path / "a.csv").write_text(
        "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country,Extra\n"
        "536365,85123A,,6,2010-12-01 08:26:00,2.55,17850.0,United Kingdom,x\n"
        "C1,S,d,-1,not a date,1.5,,France,y\n"
    )
    df = tables.read_raw(spark, str(path), "csv")
    assert [f.dataType for f in df.schema.fields[:8]] == [f.dataType for f in RAW.fields]
    rows = {r["InvoiceNo"]: r for r in df.collect()}
    assert rows["536365"]["CustomerID"] == 17850 and str(rows["536365"]["InvoiceDate"]) == "2010-12-01 08:26:00"
    assert rows["536365"]["Description"] is None
    assert rows["C1"]["InvoiceDate"] is None and rows["C1"]["CustomerID"] is None and rows["C1"]["Extra"] == "y"


def test_raw_csv_without_a_column(spark, tmp_path):
    path = tmp_path / "raw"
    path.mkdir()
    (path / "a.csv").write_text("InvoiceNo,StockCode\n1,2\n")
    with pytest.raises(ValueError, match="Description"):
        tables.read_raw(spark, str(path), "csv")


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_qualified_roundtrip(spark, raw_lines, tmp_path, fmt):
    df = clean(raw_lines({}, {"Quantity": 3, "Description": None}))
    path = tables.write_qualified(df.selectExpr("*", "1 AS extra"), str(tmp_path / "q"), fmt)
    back = tables.read_qualified(spark, path, fmt)
    assert back.columns == QUALIFIED_COLUMNS and back.schema == QUALIFIED
    assert back.exceptAll(df.select(QUALIFIED_COLUMNS)).isEmpty()


def test_absent_optional_columns_are_skipped(spark, raw_lines, tmp_path):
    path = tables.write_qualified(raw_lines({}), str(tmp_path / "q"))
    assert spark.read.parquet(path).columns == EXPECTED_COLUMNS


def test_features_write_only_canonical_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "x")], "CustomerID bigint, Recency int, FutureRevenue string")
    path = tables.write_features(df, str(tmp_path / "f"))
    assert spark.read.parquet(path).columns == ["CustomerID", "Recency"]
    with pytest.raises(ValueError):
        checks.require_feature_columns(spark.read.parquet(path))
    assert checks.overlapping_columns(df) == ["FutureRevenue"]


def test_report_roundtrip_and_absence(spark, tmp_path):
    path = str(tmp_path / "r")
    assert tables.read_report(spark, path) is None
    df = spark.createDataFrame([(1, None)], "a int, b string")
    tables.write_report(df, path)
    assert tables.read_report(spark, path, df.schema).first().asDict() == {"a": 1, "b": None}


def test_column_checks():
    with pytest.raises(ValueError, match="FutureRevenue"):
        checks.require_no_future_columns([*FEATURE_COLUMNS, "FutureRevenue"])
    checks.require_predictors()
    with pytest.raises(ValueError, match="RFM_Score"):
        checks.require_predictors(["Recency", "RFM_Score"])


HEAD = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("12/1/2010 8:26", "2010-12-01 08:26:00"), ("1/31/2011", "2011-01-31 00:00:00"), ("2010-12-01T08:26", "2010-12-01 08:26:00"),
        ("12/1/2010 08:26:30", "2010-12-01 08:26:30"), ("2010-12-01", "2010-12-01 00:00:00"), ("31/31/2010", "None"), ("soon", "None"),
    ],
)
def test_forms_of_dates(spark, text, wanted):
    row = spark.createDataFrame([(text,)], "d string").select(tables.lenient_timestamp("d").alias("t")).first()
    assert str(row["t"]) == wanted


def test_quoted_line_breaks_and_not_a_number(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + '1,S,"two\nlines, ""quoted""",6,12/1/2010 8:26,NaN,17850.0,France\n2,S,d,1,2010-12-01,2.5,,\n')
    rows = {r["InvoiceNo"]: r for r in tables.read_raw(spark, str(tmp_path), "csv").collect()}
    assert rows["1"]["Description"] == 'two\nlines, "quoted"' and rows["1"]["UnitPrice"] is None
    assert rows["1"]["CustomerID"] == 17850 and rows["2"]["CustomerID"] is None
    assert clean(tables.read_raw(spark, str(tmp_path), "csv")).count() == 0


def test_numbers_that_are_none_are_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "1,S,d,6,2010-12-01,1.5,17850.5,France\n")
    with pytest.raises(Exception, match="not a whole number"):
        tables.read_raw(spark, str(tmp_path), "csv").collect()


def test_qualified_csv_by_name_with_decimal_ids(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "CustomerID,InvoiceNo,InvoiceDate,UnitPrice,Quantity,Revenue,IsCancellation,Country,StockCode,Description\n"
        "17850.0,536365,2010-12-01 08:26:00,2.5,4,10.0,False,France,S,d\n"
    )
    back = tables.read_qualified(spark, str(tmp_path), "csv")
    assert back.schema == QUALIFIED
    row = back.first()
    assert (row["CustomerID"], row["InvoiceNo"], row["Revenue"], row["IsCancellation"]) == (17850, "536365", 10.0, False)


def test_parquet_is_brought_to_the_declared_types(spark, raw_lines, tmp_path):
    odd = raw_lines({}, {"CustomerID": None}).selectExpr(
        "InvoiceNo", "StockCode", "Description", "cast(Quantity AS bigint) AS Quantity", "cast(InvoiceDate AS string) AS InvoiceDate",
        "UnitPrice", "coalesce(cast(CustomerID AS double), double('NaN')) AS CustomerID", "Country",
    )
    odd.write.parquet(str(tmp_path / "raw"))
    back = tables.read_raw(spark, str(tmp_path / "raw"))
    assert back.schema == RAW
    assert sorted(str(r["CustomerID"]) for r in back.collect()) == ["17850", "None"]
    assert clean(back).count() == 1


def test_a_price_that_is_no_number_does_not_qualify(raw_lines):
    assert clean(raw_lines({"UnitPrice": float("nan")}, {})).count() == 1


def test_small_amounts_add_up(lines):
    from cohortspark.functions.columns import exact_sum

    total = lines(*[{"UnitPrice": 0.00004, "Quantity": 1}] * 1000).agg(exact_sum("Revenue").alias("s")).first()["s"]
    assert total == pytest.approx(0.04, abs=1e-12)
