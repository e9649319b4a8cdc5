import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, cell

SF = "/root/testdata/sf0.001"
SAMPLE = ["F-01_robust_z", "F-01_robust_z_spread", "F-05_channel_peers", "J-20_recommendation", "B-09_eligibility_reasons", "E-08_harness_metrics", "E-22_conformal_radius", "K-11_parameter_grid"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "recommendation" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_agrees(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(tuple(str(cell(r[c])) for c in cols) for r in df.collect())
    want = sorted(tuple(str(cell(r[rel.columns.index(c)])) for c in cols) for r in rel.fetchall())
    assert got == want
