"""Every registered query of the engine against its SQL."""

import glob
import math
import os

import duckdb
import pytest

from arbora.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    out = [tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)]
    return columns, sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got.columns)
    if name in registry.ORACLE_SQL:
        (a, x), (b, y) = rows(got), rows(duck.execute(registry.ORACLE_SQL[name]).df())
        assert a == b and len(x) == len(y)
        for r, s in zip(x, y, strict=True):
            assert all(p == q or (isinstance(p, float) and math.isclose(p, q, rel_tol=1e-9)) for p, q in zip(r, s, strict=True)), (r, s)


def test_entry_and_oracles_fit_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
