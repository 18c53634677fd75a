"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pytest

from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
catalog.discover()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{t}')")
    return con


def plain(v: object) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.5g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    out = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in out.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_has_rows(spark, name):
    assert not catalog.QUERIES[name](spark, DATA).isEmpty()


def test_knn_detector_equals_brute_force_over_all_dimensions(spark, duck):
    ids, vectors = zip(*duck.execute("select vec_id, embedding from embeddings").fetchall(), strict=True)
    v = np.array(vectors, float)
    assert v.shape[1] == 64
    scores = np.sort(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 1)[:, 4]
    want = dict(zip(ids, (scores > np.percentile(scores, 95)).astype(int).tolist(), strict=True))
    assert {r.vec_id: r.label for r in catalog.QUERIES["det_knn_detector"](spark, DATA).collect()} == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_simple_maps_scan_only_their_columns(spark):
    plan = catalog.QUERIES["sel_columns"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" in plan and "l_shipdate" not in plan and "Exchange" not in plan
