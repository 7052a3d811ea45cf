"""Decoy features keep every row."""

from gridproof.operators import perturb


def test_rows_without_a_group_stay(spark):
    rows = [(1, "a", 1000.0), (2, "a", 3000.0), (3, None, 5000.0), (4, None, 1000.0), (5, "b", None)]
    df = spark.createDataFrame(rows, "k long, g string, v double")
    got = sorted(map(tuple, perturb.decoy_features(df, "k", "v", "g").collect()))
    assert [r[:3] for r in got] == rows
    assert [r[3:] for r in got] == [(1100.0, 1, False), (3300.0, 3, True), (5500.0, 5, True), (1100.0, 1, False), (None, None, None)]
