from cohortspark.operators import audit, cleaning


def test_fill_only_touches_missing_descriptions(raw_lines):
    df = cleaning.fill_descriptions(raw_lines({"Description": None}, {"Description": "x"}))
    assert sorted(r["Description"] for r in df.collect()) == ["Unknown", "x"]


def test_exact_duplicates_keep_one_copy_and_nulls_are_equal(raw_lines):
    df = raw_lines({}, {}, {"CustomerID": None}, {"CustomerID": None}, {"Quantity": 7})
    assert cleaning.drop_exact_duplicates(df).count() == 3


def test_cancellation_is_a_capital_prefix_and_missing_numbers_are_not_one(raw_lines):
    df = cleaning.flag_cancellations(raw_lines({"InvoiceNo": None}, {"InvoiceNo": "C1"}, {"InvoiceNo": "c1"}))
    assert {r["InvoiceNo"]: r["IsCancellation"] for r in df.collect()} == {None: False, "C1": True, "c1": False}
    assert df.count() == 3


def test_qualifying_needs_all_four_conditions(raw_lines):
    df = raw_lines(
        {},
        {"CustomerID": None},
        {"InvoiceNo": "C536365"},
        {"Quantity": 0},
        {"Quantity": -1},
        {"UnitPrice": 0.0},
        {"UnitPrice": -0.5},
        {"InvoiceNo": None, "StockCode": "kept"},
    )
    kept = cleaning.qualifying(df).collect()
    assert sorted(r["StockCode"] for r in kept) == ["85123A", "kept"]
    assert all(abs(r["Revenue"] - 15.3) < 1e-9 for r in kept)


def test_filling_comes_before_deduplication(raw_lines):
    df = raw_lines({"Description": None}, {"Description": "Unknown"})
    assert cleaning.clean(df).count() == 1
    assert audit.audit(df).first()["exact_duplicates"] == 0


def test_cleaned_columns_are_in_order(raw_lines):
    from cohortspark.config import QUALIFIED_COLUMNS

    assert set(cleaning.clean(raw_lines({})).columns) == set(QUALIFIED_COLUMNS)


def test_one_table_of_copies_gives_all_counts_of_duplicates(raw_lines):
    odd = [{}, {}, {"Description": None}, {"Description": None}, {"Description": "Unknown"}, {"CustomerID": None}, {"Quantity": 7}]
    for rows in (odd, odd[:1], [{"Description": None}] * 3, []):
        df = raw_lines(*rows) if rows else raw_lines({}).limit(0)
        copies = cleaning.line_copies(df)
        assert audit.duplicates_of(copies).collect() == audit.duplicate_rows(df).collect()
        filled = cleaning.drop_exact_duplicates(cleaning.fill_descriptions(df))
        assert cleaning.distinct_lines(copies).columns == filled.columns
        assert sorted(map(str, cleaning.distinct_lines(copies).collect())) == sorted(map(str, filled.collect()))
        assert audit.stage_counts(df).first()["deduplicated_rows"] == filled.count()
