"""Every registered query that has an SQL twin gives the same rows as DuckDB."""

import math

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")

from tessera.queries import ORACLE_SQL, QUERIES  # noqa: E402
from tessera.sources.documents import TABLES  # noqa: E402


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in df.itertuples(index=False)]
    return list(df.columns), sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_duckdb(spark, data, duck, name):
    got = QUERIES[name](spark, data).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    (columns, rows), (names, want) = plain(got), plain(duck.sql(ORACLE_SQL[name]).df())
    assert columns == names
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9)) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
