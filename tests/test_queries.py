"""Every query of the rule-table engine against its SQL on the smallest tables, and on rows dealt differently."""

import math
from pathlib import Path

import duckdb
import pytest

from rulelens import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6))
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    told = duck.sql(catalog.oracle_sql()[name])
    assert sorted(told.columns) == columns
    want = sorted(tuple(map(plain, r)) for r in told.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
