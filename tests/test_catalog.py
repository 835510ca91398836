import duckdb
import pytest

from tracewright.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations benchmark embeddings".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda x: sorted(map(str, x[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)
