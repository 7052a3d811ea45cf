"""Decompositions of orders with their lines into two and three tables, whole and damaged, each with the issues that SQL counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import shape
from ..sources.shared import bucketed, forget
from .fixtures import table
from .registry import query


KEYS = ["k1", "k2"]
ROWS = 500_000  # lines of a bucket


def _tables(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole relation, its lines and its orders, each written once in buckets of the keys, which are pairs."""
    lines = table(s, d, "lineitem").selectExpr("l_orderkey AS k1", "l_orderkey % 3 AS k2", "l_partkey", "l_quantity")
    orders = table(s, d, "orders").selectExpr("o_orderkey AS k1", "o_orderkey % 3 AS k2", "o_custkey", "o_orderstatus")
    buckets = min(10_000, max(s.sparkContext.defaultParallelism, lines.count() // ROWS))
    all_lines, all_orders = bucketed(lines, "all_lines", KEYS, buckets), bucketed(orders, "all_orders", KEYS, buckets)
    kept = bucketed(all_lines.join(all_orders.select(*KEYS), KEYS, "left_semi").select(*lines.columns), "lines", KEYS, buckets)
    seen = bucketed(all_orders.join(all_lines.select(*KEYS), KEYS, "left_semi").select(*orders.columns), "orders", KEYS, buckets)
    whole = bucketed(kept.join(seen, KEYS), "whole", KEYS, buckets)
    forget(all_lines, all_orders)
    return whole, kept, seen


_WITH = """
WITH lines AS (SELECT l_orderkey AS k FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)), keys AS (SELECT DISTINCT k FROM lines),
n AS (SELECT (SELECT count(*) FROM lines WHERE k % 97 = 0) AS lost, (SELECT count(*) FROM keys WHERE k % 89 = 0) AS twice, (SELECT count(*) FROM lines l JOIN orders o ON l.k = o.o_orderkey WHERE k % 83 = 0 AND o_orderstatus <> 'X') AS altered)
"""


@query(f"""{_WITH}
SELECT kind, issue, part, n FROM (
  SELECT 'lost rows' AS kind, 'join_record_missing' AS issue, 'status' AS part, lost::BIGINT AS n FROM n
  UNION ALL SELECT 'repeated keys', 'unsafe_join_cardinality', 'customer', twice FROM n
  UNION ALL SELECT 'orphans', 'orphan_join_record', 'customer', 1
  UNION ALL SELECT 'null key', 'null_join_key', 'status', 1
  UNION ALL SELECT 'altered', 'relational_inverse_mismatch', NULL, 2 * altered FROM n
  UNION ALL SELECT 'lost line', 'relational_inverse_mismatch', NULL, (SELECT count(*) FROM lines WHERE k IN (SELECT k FROM lines GROUP BY k HAVING count(*) > 1)) - (SELECT count(*) FROM keys WHERE k IN (SELECT k FROM lines GROUP BY k HAVING count(*) > 1))
  UNION ALL SELECT 'fields', 'relational_fields_not_lossless', NULL, 1
  UNION ALL SELECT 'twice', 'field_duplicated_across_tables', NULL, 1
  UNION ALL SELECT 'one table', 'relational_file_count_invalid', NULL, 1
) WHERE n > 0
""")
def relational_issue_cases(s, d):
    whole, lines, seen = _tables(s, d)
    customer, status = seen.select(*KEYS, "o_custkey"), seen.select(*KEYS, "o_orderstatus")
    parts = {"lines": lines, "customer": customer, "status": status}
    first = lines.groupBy("k1", "k2").agg(F.min_by(F.struct("l_partkey", "l_quantity"), F.struct("l_partkey", "l_quantity")).alias("x")).select("k1", "k2", "x.*")
    cases = {
        "clean": parts, "two tables": {"lines": lines, "orders": customer.join(status, ["k1", "k2"])}, "lost rows": parts | {"status": status.filter("k1 % 97 <> 0")}, "repeated keys": parts | {"customer": customer.unionByName(customer.filter("k1 % 89 = 0"))},
        "orphans": parts | {"customer": customer.unionByName(customer.limit(1).withColumn("k1", F.lit(-1).cast("long")))}, "null key": parts | {"status": status.unionByName(status.limit(1).withColumn("k1", F.lit(None).cast("long")))},
        "altered": parts | {"status": status.withColumn("o_orderstatus", F.when(F.col("k1") % 83 == 0, "X").otherwise(F.col("o_orderstatus")))}, "lost line": parts | {"lines": first},
        "fields": parts | {"status": status.withColumn("more", F.lit(1))}, "twice": parts | {"status": status.join(customer, ["k1", "k2"])}, "one table": {"all": whole},
    }
    issues = reduce(DataFrame.unionByName, [shape.relational_issues(whole, t, ["k1", "k2"]).select(F.lit(kind).alias("kind"), "issue", "part", "n") for kind, t in cases.items()])
    forget(whole, lines, seen)
    return issues


@query("""
SELECT 'l_orderkey' AS keys, count(DISTINCT l_orderkey) AS "distinct", count(l_orderkey) - count(DISTINCT l_orderkey) AS repeated, count(l_orderkey) = count(DISTINCT l_orderkey) AS "unique" FROM lineitem
UNION ALL SELECT 'l_orderkey,l_partkey', count(DISTINCT (l_orderkey, l_partkey)), count(*) - count(DISTINCT (l_orderkey, l_partkey)), count(*) = count(DISTINCT (l_orderkey, l_partkey)) FROM lineitem
""")
def key_dependencies(s, d):
    found = shape.unique_keys(table(s, d, "lineitem"), [["l_orderkey"], ["l_orderkey", "l_partkey"]])
    return found.withColumn("keys", F.array_join("keys", ","))
