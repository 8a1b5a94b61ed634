"""Every query of the core against its SQL on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from memloom.queries import registry

QUERIES, ORACLES = registry.collect("QUERIES"), registry.collect("ORACLES")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, data, db, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    cursor = db.execute(ORACLES[name])
    theirs_columns = [x[0] for x in cursor.description]
    assert sorted(theirs_columns) == columns
    theirs = sorted(str([plain(r[theirs_columns.index(c)]) for c in columns]) for r in cursor.fetchall())
    ours = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
