"""Decompositions: rows that differ against brute force, and how many rows are moved."""

import random
from collections import Counter

from gridproof.operators import shape
from gridproof.plans.catalog import QUERIES


def _moved(spark) -> int:
    """Rows that stages have written for shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rows_that_differ_against_brute_force(spark):
    rng = random.Random(3)
    schema = "a long, b string, x double, y string"
    for _ in range(2):
        row = lambda: (rng.choice([None, 1, 2, 3]), rng.choice([None, "p", "q"]), rng.choice([None, 0.5, 2.0]), rng.choice([None, "u"]))
        original, whole = [row() for _ in range(60)], [r for r in (row() for _ in range(60)) if None not in r[:2]]
        a, b = Counter(original), Counter(whole)
        want = sum(abs(a[r] - b[r]) for r in a.keys() | b.keys())
        assert shape._rows_differing(spark.createDataFrame(original, schema), spark.createDataFrame(whole, schema), ["a", "b"]) == want
    assert shape._rows_differing(spark.createDataFrame(whole, schema), spark.createDataFrame(whole[::-1], schema), ["a", "b"]) == 0


def test_cases_of_one_relation_move_it_once(spark):
    data = "/root/testdata/sf0.01"
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    spark.range(1).collect()
    before = _moved(spark)
    QUERIES["relational_issue_cases"](spark, data).collect()
    assert _moved(spark) - before < 6 * lines
