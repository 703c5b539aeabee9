"""Every query of the core library that has an oracle gives the oracle's rows on the smallest tables."""

import math

import duckdb
import pytest

from leadspark.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6f}"
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(duck.sql(ORACLES[name]).columns)
    got = sorted(str([plain(v) for v in r]) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    picked = ", ".join(f'"{c}"' for c in columns)
    want = sorted(str([plain(v) for v in r]) for r in duck.sql(f"SELECT {picked} FROM ({ORACLES[name]})").fetchall())
    assert got == want
