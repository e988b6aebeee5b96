"""Every query with a SQL equivalent, compared with DuckDB on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from quadrat.catalog import QUERIES  # noqa: E402
from quadrat.oracle import ORACLE  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-5)
    return a == b


def _key(row):
    return repr(tuple(round(v, 4) + 0.0 if isinstance(v, float) else v for v in row))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)
    res = duck.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=_key)
    assert len(got) == len(want)
    assert all(_close(x, y) for g, w in zip(got, want) for x, y in zip(g, w))
