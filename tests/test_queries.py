"""Every query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tapewright.plans import queries as core
from tapewright.plans import state_queries, surface_queries, view_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    return str(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else str(x)


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) & set(core.ORACLE_SQL)))
def test_query_equals_sql(spark, small, tables, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    sql = tables.execute(core.ORACLE_SQL[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == columns
    want = sorted([plain(dict(zip(names, r, strict=True))[c]) for c in columns] for r in sql.fetchall())
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
