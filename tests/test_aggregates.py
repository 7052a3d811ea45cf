"""Aggregates of numbers in text are exact in any order of rows."""

import duckdb

from gridproof.operators import files
from gridproof.plans.catalog import ORACLE_SQL, QUERIES


def test_totals_are_exact(spark):
    rows = [("tenths", "0.10")] * 10 + [("wide", v) for v in ("900,000,000,000.01", "0.02", "0.03", "-900,000,000,000.01")] + [("share", "5%"), ("share", " "), ("share", "none"), ("blank", " "), ("large", "1e300"), ("large", "0.5")]
    got = {r.k: tuple(r)[1:] for r in files.computed_aggregates(spark.createDataFrame(rows, "k string, v string"), ["k"], "v").collect()}
    assert got == {
        "tenths": (10, 1.0, 0.1, 0.1, 0.1), "wide": (4, 0.05, 0.0125, -900000000000.01, 900000000000.01), "share": (2, 0.05, 0.05, 0.05, 0.05), "blank": (0, None, None, None, None), "large": (2, 1e300, 5e299, 0.5, 1e300),
    }


def test_means_are_printed_as_the_exact_double(spark, tmp_path):
    prices = [("F", 0.03), *[("F", 0.0)] * 7, *[("O", 0.1)] * 10, ("P", 90000000000.01), *[("P", 0.01)] * 9]
    spark.createDataFrame(prices, "o_orderstatus string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    df = QUERIES["computed_aggregates"](spark, str(tmp_path))
    found = db.execute(ORACLE_SQL["computed_aggregates"])
    at = [[x[0] for x in found.description].index(c) for c in df.columns]
    assert sorted(tuple(r[i] for i in at) for r in found.fetchall()) == sorted(map(tuple, df.collect()))
