"""Every query of the catalogue against its SQL, on the smallest driver tables."""

import math
from pathlib import Path

import duckdb
import pytest

from framewise.plans import catalog, catalog_merging, catalog_more, catalog_rounds, catalog_session, catalog_surface  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return "None" if v is None or isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    if name not in catalog.SQL:
        assert got
        return
    r = duck.execute(catalog.SQL[name])
    said = [x[0] for x in r.description]
    assert sorted(said) == names
    assert got == sorted(tuple(plain(row[said.index(n)]) for n in names) for row in r.fetchall())


def test_streams_equal_batches(spark):
    batch = {(r.user_id, r.id) for r in catalog.QUERIES["rate_limited"](spark, SF).where("taken").collect()}
    assert {(r.key, r.id) for r in catalog.QUERIES["stream_rate_limit"](spark, SF).collect()} == batch
