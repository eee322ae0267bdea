"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from ledgerloom.plans import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    cols = sorted(want.columns)
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == cols
    rows = lambda names, found: sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found), key=repr)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
