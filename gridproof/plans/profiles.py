"""Profiles of many sheets and results of validators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, profile
from .fixtures import table
from .registry import query

_FIELDS = ["verdict", *gates.CORE_FIELDS, "hardness_valid", "can_answer", "should_refuse", "fabricated_answer", "original_files_checked", "final_files_checked"]


@query(f"""
WITH e AS (SELECT event_id, event_id % 17 AS f, CASE WHEN event_id % 3 = 0 THEN 'deep_analysis_missing' ELSE 'file_missing' END AS operator FROM events),
x AS (SELECT *, CASE WHEN f < {len(_FIELDS)} AND NOT (f = {_FIELDS.index("hardness_valid")} AND operator = 'file_missing') THEN [{", ".join(repr(c) for c in _FIELDS)}][f + 1] END AS failed FROM e)
SELECT event_id, failed IS NULL AS accepted, failed, CASE WHEN failed = 'verdict' THEN CASE WHEN event_id % 2 = 0 THEN 'said so' ELSE 'verdict=failed' END WHEN failed LIKE '%\\_checked' ESCAPE '\\' THEN 'evidence missing: ' || failed WHEN failed IS NOT NULL THEN 'field failed: ' || failed END AS reason FROM x
""")
def validator_gate(s, d):
    e = table(s, d, "events").select("event_id", (F.col("event_id") % 17).alias("f"), F.when(F.col("event_id") % 3 == 0, "deep_analysis_missing").otherwise("file_missing").alias("operator"))
    broken = lambda c: F.col("f") == _FIELDS.index(c)
    true = {c: ~broken(c) for c in (*gates.CORE_FIELDS[:3], "hardness_valid", "should_refuse")} | {c: F.when(~broken(c), True) for c in gates.CORE_FIELDS[3:]}
    seen = {c: F.when(~broken(c), F.array(F.lit("t.csv"))) for c in ("original_files_checked", "final_files_checked")}
    rest = {"verdict": F.when(broken("verdict"), "failed").otherwise("passed"), "can_answer": broken("can_answer"), "fabricated_answer": F.when(broken("fabricated_answer"), True), "refusal_reason": F.when(F.col("event_id") % 2 == 0, "said so"), "failure_reason": F.lit(None).cast("string")}
    return gates.validator_gate(e.withColumns(true | seen | rest)).select("event_id", "accepted", "failed", "reason")


@query("""
WITH n AS (SELECT s_nationkey AS k, s_suppkey, s_name, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier),
c AS (SELECT k, max(r) AS n, max(CASE WHEN r = 1 THEN s_suppkey END) AS first FROM n GROUP BY k)
SELECT k::VARCHAR AS sheet, (n + 1)::INTEGER AS max_row, CASE WHEN k % 5 = 0 THEN 210 ELSE 4 END::INTEGER AS max_column, n::INTEGER AS n_rows, CASE WHEN k % 5 = 0 THEN 200 ELSE 4 END::INTEGER AS profiled_column_count, k % 5 = 0 AS column_profile_truncated, 1::INTEGER AS header_row_number,
  CASE WHEN k % 3 = 0 THEN 'name|name.1|Unnamed: 2|balance' ELSE 'id|name|Unnamed: 2|balance' END AS columns, 'number|text|empty|number' AS dtypes, first::VARCHAR AS sample, least(n, 8)::INTEGER AS samples,
  (1 + CASE WHEN k % 5 = 0 THEN 196 ELSE 0 END)::BIGINT AS unnamed_column_count, CASE WHEN k % 3 = 0 THEN 'name.1' ELSE '' END AS duplicate_like_columns, CASE WHEN k % 3 = 0 THEN 'name' ELSE '' END AS duplicate_base_names, k % 3 = 0 AS possible_duplicate_header, false AS dimension_suspect
FROM c
""")
def sheet_reports(s, d):
    n = table(s, d, "supplier").selectExpr("s_nationkey AS k", "s_suppkey", "s_name", "s_acctbal", "cast(1 + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS int) AS row")
    cell = "struct({} AS col, '{}' AS vtype, cast({} AS string) AS value)".format
    body = n.selectExpr("k", "row", f"explode(array({cell(1, 'bigint', 's_suppkey')}, {cell(2, 'string', 's_name')}, {cell(4, 'double', 's_acctbal')})) AS c")
    extra = f", {cell(210, 'string', chr(39) + chr(39))}"
    heads = n.filter("row = 2").selectExpr("k", "1 AS row", f"explode(concat(array({cell(1, 'string', 'if(k % 3 = 0, ' + repr('name') + ', ' + repr('id') + ')')}, {cell(2, 'string', repr('name'))}, {cell(4, 'string', repr('balance'))}), if(k % 5 = 0, array({extra[2:]}), array()))) AS c")
    grid = body.unionByName(heads).selectExpr("'supplier' AS file", "cast(k AS string) AS sheet", "row", "c.col", "c.vtype", "c.value")
    said = profile.sheet_report(grid)
    four = lambda c: F.array_join(F.slice(c, 1, 4), "|")
    return said.select(
        "sheet", "max_row", "max_column", "n_rows", "profiled_column_count", "column_profile_truncated", "header_row_number", four("columns").alias("columns"), four("dtypes").alias("dtypes"), F.col("sample_rows")[0][0].alias("sample"), F.size("sample_rows").alias("samples"),
        "unnamed_column_count", F.array_join("duplicate_like_columns", "|").alias("duplicate_like_columns"), F.array_join("duplicate_base_names", "|").alias("duplicate_base_names"), "possible_duplicate_header", "dimension_suspect",
    )
