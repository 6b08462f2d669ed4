"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from locusfold import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf_dir, con):
    df = catalog.queries()[name](spark, sf_dir)
    rows = df.collect()
    oracle = catalog.oracle_sql().get(name)
    if oracle is None:
        assert df.columns and len(rows) > 0
        return
    rel = con.sql(oracle)
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in df.columns]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(map(norm, r)) for r in rows), key=repr) == want
