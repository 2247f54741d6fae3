"""Each query agrees with its SQL on the smallest tables."""

import math
import os

import pytest

from cartosieve.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def normal(rows):
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "as_tuple") else v
    return sorted([tuple(cell(v) for v in r) for r in rows], key=repr)


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute("SELECT {} FROM ({})".format(", ".join(f'"{c}"' for c in columns), registry.ORACLES[name])).fetchall()
    assert normal(df.select(*columns).collect()) == normal(want)


def test_flagship(spark):
    assert registry.FLAGSHIP(spark, SF).count() > 0
