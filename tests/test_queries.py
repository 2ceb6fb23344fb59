"""Every query with a SQL twin gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from claimworks.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    mine = _rows(got.columns, [tuple(r) for r in got.collect()])
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        assert mine == _rows([d[0] for d in cursor.description], cursor.fetchall())
