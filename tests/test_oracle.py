"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from docloom.catalog import ORACLES, QUERIES
from docloom.sources import SCHEMAS
from tools.check import table


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in SCHEMAS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf, db):
    df = QUERIES[name](spark, sf)
    ours = table(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(ORACLES[name])
    assert ours == table([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
