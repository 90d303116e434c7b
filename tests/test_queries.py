"""Every query of the core against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from arborix.plans import registry
from tools.compare import rows_of

DATA = Path("/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else str(p) + '/*.parquet'}')")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    got = [tuple(r) for r in df.collect()]
    if name in SQL:
        want = con.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows_of(df.columns, got) == rows_of(want.columns, want.fetchall())


def test_names():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) == sum(len(m.QUERIES) for m in registry.MODULES)
