"""Every core query beside its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

from readloom.operators import rescue
from readloom.plans import catalog

DIR = "/root/testdata/sf0.001"


def norm(v):
    return ("nan" if v != v else f"{v:.9g}") if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_parity(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    rel = con.sql(catalog.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
def test_realign_merges_once(spark, monkeypatch):
    seen, whole = spark.sparkContext.accumulator(0), rescue.rescue

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def once(*args, **kw):
        rec, bases = whole(*args, **kw)
        return rec.mapInArrow(counted, rec.schema), bases

    monkeypatch.setattr(rescue, "rescue", once)
    catalog.QUERIES["rescue_realign"](spark, DIR).collect()
    n = catalog.QUERIES["rescue_records"](spark, DIR)
    seen_once = seen.value
    assert seen_once == n.count() > 0
