"""Every registered query against its SQL on the smallest tables."""

import collections
import math

import pytest

from agendaflow.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations benchmark".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "as_integer_ratio"):
        return int(v)
    return str(v)[:10] if hasattr(v, "isoformat") and str(v).endswith("00:00:00") else str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*columns).collect()] if name in catalog.oracle_sql() else None
    if got is None:
        assert df.count() > 0
        return
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = [tuple(map(plain, r)) for r in duck.sql(f"SELECT {quoted} FROM ({catalog.oracle_sql()[name]})").fetchall()]
    assert collections.Counter(got) == collections.Counter(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
