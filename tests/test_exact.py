"""Queries against their SQL to the last bit: signs of zero, roundings of binary halves."""

import random

import duckdb
from sonolake.plans import registry

registry.load()


def both(spark, name, path, **tables):
    """(got, wanted) rows of a query over small tables, as text."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, str(path)).select(*want.columns)
    return sorted(str(tuple(r)) for r in got.collect()), sorted(map(str, want.fetchall()))


def test_trims_round_as_in_sql(spark, tmp_path):
    money = [-4.0, -49.99, 4.0, 0.0, 1045.0, -1045.0, 5125.0, 250.0, -250.0, 1150.0, 9999.5, -50.0, None]
    rows = [(3 * k + 1, f"Supplier#{k:09d}", m) for k, m in enumerate(money)] + [(3, "Supplier#000000099", 7.0)]
    got, want = both(spark, "destination_parse", tmp_path, supplier=spark.createDataFrame(rows, "s_suppkey long, s_name string, s_acctbal double"))
    assert got == want
    assert "(1, 'Supplier', -0.0)" in got


def test_small_coefficients_keep_their_sign(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 2e-7) for _ in range(64)]) for k in range(20)] + [(20, [0.0] * 64)]
    got, want = both(spark, "lapped_transform", tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert got == want
    assert "-0.0" in got[0]
