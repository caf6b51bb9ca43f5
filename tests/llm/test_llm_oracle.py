import duckdb
import pytest

from cohortspark.llm import oracle, queries


@pytest.mark.parametrize("name", oracle.SQL)
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, name, folder):
    connection = duckdb.connect()
    for given in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {given} AS SELECT * FROM '{folder}/{given}.parquet'")
    wanted = connection.execute(oracle.SQL[name])
    columns = [c[0] for c in wanted.description]
    found = queries.QUERIES[name](spark, folder)
    assert found.columns == columns
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted.fetchall())


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
