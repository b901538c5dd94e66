"""Every query of the library against its SQL in DuckDB, over the same tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from parlance.plans import registry

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else round(v, 6) + 0.0
    if type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def key(row):
    return [(x is None, str(x)) for x in row]


@pytest.mark.parametrize("name", sorted(set(registry.queries()) & set(registry.oracle_sql())))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, FOLDER)
    got = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    want = got.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in df.columns]
    a = sorted(([plain(x) for x in r] for r in df.collect()), key=key)
    b = sorted(([plain(r[k]) for k in order] for r in want), key=key)
    assert len(a) == len(b) and len(a) > 0
    assert [x for x in zip(a, b) if x[0] != x[1]][:3] == []


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0
