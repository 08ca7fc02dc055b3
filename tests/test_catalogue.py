"""Every registered query against its SQL at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from fluxgrid.plans import rows as catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]

    def text(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return str(v) if isinstance(v, str) else f"{float(v):.9g}" if hasattr(v, "__float__") else str(v)

    return list(frame.columns), sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, DATA).toPandas()
    theirs = duck.sql(catalogue.ORACLES[name]).df()
    assert canonical(ours) == canonical(theirs)


def test_random_numbers_stay_in_their_range(spark):
    rows = catalogue.QUERIES["random_numbers"](spark, DATA).collect()
    assert [(r.inside, r["count"]) for r in rows] == [(True, 1000)]
