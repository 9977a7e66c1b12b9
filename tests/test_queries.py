"""Every query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from loomframe.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - {"gen_decision_grid"}))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in plans.ORACLES:
        assert rows
        return
    got = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert ordered(rows, df.columns) == ordered(got.fetchall(), names)
