"""Every query with a SQL twin returns the twin's rows on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from ledgerloom.plans import catalog

FOLDER = os.environ.get("LEDGERLOOM_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REGISTRY = catalog.registry()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    yield con
    con.close()


def text(value):
    if value is None:
        return "null"
    if isinstance(value, (float, decimal.Decimal)) and not isinstance(value, bool):
        return "nan" if math.isnan(value) else f"{float(value):.6g}"
    if isinstance(value, dict):
        return text(list(value.values()))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(text, value)) + "]"
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    return str(value)


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_query_returns_the_rows_of_its_sql(spark, database, name):
    found = REGISTRY.queries[name](spark, FOLDER)
    cursor = database.execute(REGISTRY.sql[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    want = sorted("|".join(map(text, row)) for row in cursor.fetchall())
    assert sorted("|".join(text(row[c]) for c in columns) for row in found.collect()) == want


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.sql)))
def test_queries_without_sql_have_rows(spark, name):
    assert REGISTRY.queries[name](spark, FOLDER).count() > 0
