"""The selection log of all samples in one query: every stage, and operators that nobody mentioned."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import select
from .fixtures import table
from .registry import query

_ENTRIES = """
SELECT l_orderkey AS sample, 'op' || l_suppkey % 7 AS operator, CASE WHEN l_partkey % 3 = 0 THEN 'rejected' ELSE 'eligible' END AS verdict, l_partkey % 11 = 0 AS unreadable, l_quantity / 50.0 AS c,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal, 'part ' || l_partkey AS reason FROM lineitem
"""


@query(f"""
WITH entries AS ({_ENTRIES}),
said AS (SELECT *, CASE WHEN unreadable THEN NULL ELSE c END AS raw, CASE WHEN unreadable THEN 0.0 ELSE c END AS conf FROM entries),
yes AS (SELECT sample, operator, conf, reason, min(ordinal) OVER (PARTITION BY sample, operator) AS first, row_number() OVER (PARTITION BY sample, operator ORDER BY conf DESC, ordinal) AS r FROM said WHERE verdict = 'eligible'),
no AS (SELECT sample, operator, raw, reason, row_number() OVER (PARTITION BY sample, operator ORDER BY ordinal) AS r FROM said WHERE verdict = 'rejected'),
catalog AS (SELECT * FROM (VALUES ('op0', 2, 0.3, 1), ('op1', 1, NULL, 1), ('op2', 1, 0.5, 1), ('op3', 3, NULL, 2), ('op4', 1, 0.1, 3)) v(operator, priority, min_confidence, least_files)),
grid AS (SELECT o_orderkey AS sample, 1 + o_custkey % 3 AS file_count, catalog.* FROM orders, catalog),
judged AS (
  SELECT g.sample, g.operator, g.priority, y.conf, y.first, n.raw, coalesce(y.reason, n.reason) AS reason,
    CASE WHEN y.sample IS NULL THEN CASE WHEN n.sample IS NULL THEN 'model_omitted' ELSE 'model_rejected' END
      WHEN file_count < least_files THEN 'static_ineligible' WHEN y.conf < coalesce(min_confidence, 0.65) THEN 'below_confidence_threshold' END AS stage
  FROM grid g LEFT JOIN yes y ON g.sample = y.sample AND g.operator = y.operator AND y.r = 1 LEFT JOIN no n ON g.sample = n.sample AND g.operator = n.operator AND n.r = 1
),
placed AS (SELECT *, CASE WHEN stage IS NULL THEN row_number() OVER (PARTITION BY sample, stage ORDER BY priority, conf DESC, first) END AS position FROM judged)
SELECT sample, operator, CASE WHEN stage IS NULL AND position <= 2 THEN 'selected' ELSE 'rejected' END AS status, CASE WHEN stage IS NULL AND position > 2 THEN 'max_attacks_limit' ELSE stage END AS stage,
  position, coalesce(conf, raw) AS confidence, reason
FROM placed
""")
def selection_stages(s, d):
    entries = s.sql(_ENTRIES.replace("FROM lineitem", "FROM {lines}"), lines=table(s, d, "lineitem")).withColumn("confidence", F.when(F.col("unreadable"), "n/a").otherwise(F.col("c").cast("string")))
    samples = table(s, d, "orders").selectExpr("o_orderkey AS sample", "1 + o_custkey % 3 AS file_count")
    catalog = s.createDataFrame([("op0", 2, 0.3, 1), ("op1", 1, None, 1), ("op2", 1, 0.5, 1), ("op3", 3, None, 2), ("op4", 1, 0.1, 3)], "operator string, priority int, min_confidence double, least_files int")
    return select.selection_log(entries, samples, catalog, 2)
