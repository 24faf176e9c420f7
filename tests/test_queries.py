"""Registered queries beside their SQL, on the smallest test tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "p1_counts", "p1_found", "p2_found", "p2_intervals", "p3_found", "p5_found", "p5_paths", "p5_below", "c1_first_party_edges", "d17_owning_folder", "f6_delivery_edges", "g1_invocation_effects", "h11_dual_writes", "h9_lazy_init_races", "j17_reaches", "g9_resource_strategies", "k1_method_parts",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    r = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    want = sorted(tuple(str(x[i]) for i in at) for x in r.fetchall())
    assert sorted(tuple(map(str, x)) for x in df.select(*cols).collect()) == want


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["provider", "operation", "nearest", "sites"] and df.where("sites > 0 and nearest >= 0").count() > 0
