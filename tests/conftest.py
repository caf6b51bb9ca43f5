import pytest
from sample import at

from cohortspark.schemas import QUALIFIED, RAW
from cohortspark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


# A default raw line.
RAW_DEFAULT = {
    "InvoiceNo": "536365",
    "StockCode": "85123A",
    "Description": "holder",
    "Quantity": 6,
    "InvoiceDate": at("2011-01-10"),
    "UnitPrice": 2.55,
    "CustomerID": 17850,
    "Country": "United Kingdom",
}


@pytest.fixture
def raw_lines(spark):
    """Raw lines from partial rows."""

    def build(*rows):
        full = [{**RAW_DEFAULT, **r} for r in rows]
        return spark.createDataFrame([tuple(r[f.name] for f in RAW.fields) for r in full], RAW)

    return build


@pytest.fixture
def lines(spark):
    """Qualified lines from partial rows; Revenue defaults to quantity times price."""

    def build(*rows):
        full = []
        for r in rows:
            r = {**RAW_DEFAULT, "IsCancellation": False, **r}
            r["InvoiceDate"] = at(r["InvoiceDate"]) if isinstance(r["InvoiceDate"], str) else r["InvoiceDate"]
            r.setdefault("Revenue", float(r["Quantity"] * r["UnitPrice"]))
            full.append(tuple(r[f.name] for f in QUALIFIED.fields))
        return spark.createDataFrame(full, QUALIFIED)

    return build


@pytest.fixture
def values(spark):
    """(CustomerID, column) from a list of values; ids count from 1."""

    def build(column, data, kind="double"):
        return spark.createDataFrame([(i + 1, v) for i, v in enumerate(data)], f"CustomerID bigint, {column} {kind}")

    return build
