import math
import os

import pytest

from quadrille import queries as panel_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = list(panel_queries.oracle_sql())


def alike(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-9)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    sql = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    keyed = lambda r: ([x if isinstance(x, str | int) else "" for x in r], str(r))
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: str(keyed(r)))
    at = [sql.columns.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in at) for r in sql.fetchall()), key=lambda r: str(keyed(r)))
    assert len(mine) == len(theirs)
    assert not [(a, b) for a, b in zip(mine, theirs, strict=True) if not all(map(alike, a, b))]


def test_numbers_round_as_sql(spark):
    import duckdb
    from pyspark.sql import functions as F

    # doubles next to halves, whose decimal digits and scaled values round apart
    values = [s * (k + 0.5) / 1e6 for k in (*range(0, 3_400_000, 1013), 1000542, 2037482, 523231) for s in (1, -1)] + [0.0, -0.0, 1e300, 1e305, math.inf, -math.inf, None]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double")
    for digits in (0, 5, 6):
        mine = [r[0] for r in df.orderBy("i").select(panel_queries._number(F.col("v"), digits)).collect()]
        theirs = [r[0] for r in duckdb.execute(f"SELECT round(v, {digits}) + 0.0 FROM (SELECT unnest($1::DOUBLE[]) AS v)", [values]).fetchall()]
        assert mine == theirs
        assert all(x is None or x != 0 or math.copysign(1, x) == 1 for x in mine)


def test_entry(spark):
    import __spark_entry__ as entry

    assert not entry.entry(spark).isEmpty()
    assert set(entry.oracle_sql()) <= set(entry.queries())
