"""Every query with SQL gives DuckDB's rows on the smallest tables; those without give rows."""

import duckdb
import pytest

from corpusloom.plans import catalog, extra, markup, more, search  # noqa: F401
from corpusloom.session import TABLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def cell(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    out = catalog.QUERIES[name](spark, DIR)
    columns = sorted(out.columns)
    rows = sorted(repr([cell(r[c]) for c in columns]) for r in out.collect())
    if name not in catalog.SQL:
        assert rows
        return
    got = db.execute(catalog.SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    assert rows == sorted(repr([cell(r[names.index(c)]) for c in columns]) for r in got.fetchall())
