"""Queries of sheet structure and cells, over tables as they are and with damage, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import perturb
from ..operators import structure as st
from ..sources import grid
from .fixtures import table
from .registry import query

COLUMNS = ["s_suppkey", "s_name", "s_nationkey"]
_NUMBERED = "SELECT *, 1 + row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier"


def _grid(s, d, columns=COLUMNS):
    return grid.from_table(table(s, d, "supplier").select(*columns), "supplier", ["s_suppkey"])


def _damaged(g: DataFrame, col: int, share: int = 7) -> DataFrame:
    """Every seventh data cell of a column holds something else."""
    return g.withColumn("value", F.when((F.col("row") > 1) & (F.col("col") == col) & (F.col("row") % share == 0), F.concat("value", F.lit("!"))).otherwise(F.col("value")))


def _renamed(g: DataFrame, names: dict[str, str]) -> DataFrame:
    new = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("value"))
    return g.withColumn("value", F.when(F.col("row") == 1, F.coalesce(new, F.col("value"))).otherwise(F.col("value")))


def _cases(found: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("case"), "code", "n") for k, df in found.items()])


@query("""SELECT 'part-' || p_size % 10 AS file, '' AS sheet, coalesce(max(1 + p_partkey % 9) FILTER (WHERE p_partkey % 3 = 0 AND p_partkey % 4 > 1), 0)::INTEGER AS width FROM part GROUP BY 1""")
def active_header_width(s, d):
    p = table(s, d, "part")
    k = F.col("p_partkey") % 4
    cells = p.select(
        F.concat(F.lit("part-"), (F.col("p_size") % 10).cast("string")).alias("file"), F.lit("").alias("sheet"), (1 + F.col("p_partkey") % 3).cast("int").alias("row"), (1 + F.col("p_partkey") % 9).cast("int").alias("col"), F.when(k == 0, " \n").when(k > 1, F.col("p_name")).alias("value")
    )
    return st.active_width(cells)


@query(f"""SELECT r::INTEGER AS "row", 2 AS col, s_name AS old, s_name || '!' AS new FROM ({_NUMBERED}) WHERE r % 7 = 0 UNION ALL SELECT r::INTEGER, 3, s_nationkey::VARCHAR, NULL FROM ({_NUMBERED}) WHERE r % 11 = 0""")
def changed_cells(s, d):
    before = _grid(s, d)
    return st.changed_cells(before, _damaged(before, 2).filter("NOT (row % 11 = 0 AND col = 3)")).select("row", "col", "old", "new")


@query("SELECT unnest(['s_suppkey', 's_name', 's_nationkey']) AS name, unnest([1, 2, 3]) AS old_col, unnest([2, 3, 1]) AS new_col, unnest([true, (SELECT count(*) < 6 FROM supplier), true]) AS same")
def columns_by_header(s, d):
    after = _damaged(_grid(s, d, ["s_nationkey", "s_suppkey", "s_name"]), 3)
    return st.column_pairs(_grid(s, d), after).select("name", "old_col", "new_col", "same")


@query("""SELECT * FROM (VALUES ('content', 'column_content_changed', 1::BIGINT), ('weak', 'column_shuffle_too_weak', 1), ('other header', 'header_set_changed', 1), ('repeated header', 'duplicate_headers', 1), ('narrower', 'header_region_changed', 1), ('beside', 'non_table_column_changed', 1)) t("case", code, n)""")
def column_shuffle_issues(s, d):
    before, turned = _grid(s, d), _grid(s, d, ["s_nationkey", "s_suppkey", "s_name"])
    beside = F.when((F.col("col") == 3) & (F.col("row") == 1), F.lit(None)).otherwise(F.col("value"))
    one, two = before.withColumn("value", beside), _damaged(_grid(s, d, ["s_name", "s_suppkey", "s_nationkey"]), 3).withColumn("value", beside)
    return _cases({
        "clean": st.column_shuffle_issues(before, turned), "content": st.column_shuffle_issues(before, _damaged(turned, 2)), "weak": st.column_shuffle_issues(before, before), "other header": st.column_shuffle_issues(before, _renamed(turned, {"s_name": "x"})),
        "repeated header": st.column_shuffle_issues(before, _renamed(turned, {"s_name": "s_suppkey"})), "narrower": st.column_shuffle_issues(before, turned.filter("col < 3")), "beside": st.column_shuffle_issues(one, two),
    })


@query(f"""SELECT 'undeclared' AS "case", 'undeclared_header_change' AS code, 1::BIGINT AS n UNION ALL SELECT 'undeclared', 'header_mapping_mismatch', 2 UNION ALL SELECT 'unchanged', 'no_header_renamed', 1 UNION ALL SELECT 'unchanged', 'header_mapping_mismatch', 1
UNION ALL SELECT 'body', 'undeclared_header_change', count(*) FROM ({_NUMBERED}) WHERE r % 7 = 0 HAVING count(*) > 0 UNION ALL SELECT 'body', 'header_mapping_mismatch', count(DISTINCT s_name) FROM ({_NUMBERED}) WHERE r % 7 = 0 HAVING count(*) > 0
UNION ALL SELECT 'type', 'non_header_cell_changed', count(*) FROM supplier""")
def header_synonym_issues(s, d):
    before, declared = _grid(s, d), {"s_name": "supplier_label"}
    good = _renamed(before, declared)
    retyped = good.withColumn("vtype", F.when((F.col("col") == 1) & (F.col("row") > 1), "string").otherwise(F.col("vtype")))
    return _cases({
        "clean": st.header_synonym_issues(before, good, declared), "undeclared": st.header_synonym_issues(before, _renamed(before, {"s_name": "other"}), declared), "unchanged": st.header_synonym_issues(before, before, declared),
        "body": st.header_synonym_issues(before, _damaged(good, 2), declared), "type": st.header_synonym_issues(before, retyped, declared),
    })


@query(f"""SELECT 'cells' AS "case", 'data_cell_changed' AS code, count(*) AS n FROM ({_NUMBERED}) WHERE (r + 1) % 7 = 0 HAVING count(*) > 0 UNION ALL SELECT 'rows', 'data_row_count_changed', 1 UNION ALL SELECT 'columns', 'data_column_count_changed', 1 UNION ALL SELECT 'no start', 'header_relayout_spec_missing', 1
UNION ALL SELECT 'formulas', 'formula_set_changed', 1""")
def relayout_issues(s, d):
    before = _grid(s, d)
    after = perturb.relayout(before, COLUMNS).withColumns({"file": F.lit("supplier"), "sheet": F.lit("")})
    starts = s.createDataFrame([("supplier", "", 2, 3)], "file string, sheet string, old_start int, new_start int")
    last = after.agg(F.max("row").alias("last"))
    shorter = after.crossJoin(F.broadcast(last)).filter("row < last").drop("last")  # one row
    formula = lambda g, x: g.withColumn("formula", F.when(F.col("row") == 1, F.when(F.col("col") == 1, F.lit(x))))
    return _cases({
        "clean": st.relayout_issues(before, after, starts), "cells": st.relayout_issues(before, _damaged(after, 2).withColumn("value", F.when(F.col("row") < 3, F.regexp_replace("value", "!", "")).otherwise(F.col("value"))), starts),
        "rows": st.relayout_issues(before, shorter, starts), "columns": st.relayout_issues(before, after.filter("col < 3"), starts), "no start": st.relayout_issues(before, after, starts.limit(0)),
        "formulas": st.relayout_issues(formula(before, "=A1"), formula(after, "=A1").unionByName(formula(after, "=A2").filter("row = 1 AND col = 1").withColumns({"row": F.lit(1), "col": F.lit(3), "formula": F.lit("=A2")})).filter("NOT (row = 1 AND col = 3 AND formula IS NULL)"), starts),
    })


def _sheets(s, d, change: bool):
    k = F.col("n_nationkey") % 9 if change else F.lit(-1)
    at = lambda n, a, b: F.when(k == n, b).otherwise(a)
    return table(s, d, "nation").select(
        F.col("n_regionkey").cast("string").alias("file"), F.col("n_name").alias("sheet"), at(1, F.lit(10), F.lit(11)).alias("rows"), F.lit(3).alias("cols"), at(2, F.array(F.lit("A1:B1"), F.lit("C1:D1")), F.array(F.lit("A1:B1"))).alias("merges"),
        at(3, F.lit("A1:C10"), F.lit(None)).alias("filter_ref"), at(4, F.array(F.lit("t=A1:C10")), F.array(F.lit("t=A1:C9"))).alias("tables"), at(5, F.array(F.lit(4)), F.array(F.lit(4), F.lit(5))).alias("hidden_rows"),
        at(6, F.array(F.lit("B")), F.array().cast("array<string>")).alias("hidden_cols"), at(7, F.array(F.lit("1"), F.lit("2")), F.array(F.lit("1"), F.lit("3"))).alias("header_styles"),
    )


_CODES = ["sheet_shape_changed", "merged_ranges_changed", "filter_changed", "table_range_changed", "hidden_rows_changed", "hidden_columns_changed", "header_style_changed"]
_RULES = {
    "unit_scale_conversion": dict(enumerate(_CODES, 1)),
    "row_order_shuffle": {i: c for i, c in enumerate(_CODES, 1) if c not in ("hidden_rows_changed", "header_style_changed")},
    "excel_hierarchical_header_relayout": {5: "hidden_rows_changed", 6: "hidden_columns_changed"},
}
_FOUND = " UNION ALL ".join(f"SELECT '{o}' AS operator, n_name AS sheet, '{c}' AS code FROM nation WHERE n_nationkey % 9 = {k}" for o, rules in _RULES.items() for k, c in rules.items())


@query(_FOUND + " UNION ALL SELECT 'excel_hierarchical_header_relayout', n_name, 'header_hierarchy_not_changed' FROM nation WHERE n_nationkey % 9 <> 2")
def sheet_structure_issues(s, d):
    found = [st.sheet_issues(_sheets(s, d, False), _sheets(s, d, True), o).select(F.lit(o).alias("operator"), "sheet", "code") for o in _RULES]
    return reduce(DataFrame.unionByName, found)


@query("""WITH i AS (SELECT n_regionkey::VARCHAR AS file, n_name AS sheet, CASE n_nationkey % 9 WHEN 1 THEN 'sheet_shape_changed' WHEN 2 THEN 'merged_ranges_changed' WHEN 3 THEN 'filter_changed' WHEN 4 THEN 'table_range_changed' WHEN 5 THEN 'hidden_rows_changed' WHEN 6 THEN 'hidden_columns_changed' WHEN 7 THEN 'header_style_changed' END AS code FROM nation)
SELECT r.r_regionkey::VARCHAR AS file, count(code) = 0 AS passed, count(code) AS n_issues, coalesce(string_agg(sheet || ':' || code || ':1', ', ' ORDER BY sheet), '') AS issues FROM region r LEFT JOIN i ON i.file = r.r_regionkey::VARCHAR AND code IS NOT NULL GROUP BY 1""")
def structure_report(s, d):
    issues = st.sheet_issues(_sheets(s, d, False), _sheets(s, d, True), "unit_scale_conversion")
    return st.issue_report(issues, table(s, d, "region").select(F.col("r_regionkey").cast("string").alias("file")))


@query("""SELECT c_custkey AS sample, o AS operator, CASE WHEN o = 'row_order_shuffle' THEN 2 ELSE 1 END::INTEGER AS n_files, CASE WHEN o = 'row_order_shuffle' THEN c_custkey % 3 ELSE least(c_custkey % 3, 1) END::INTEGER AS n_sheets, o <> 'row_order_shuffle' AS constrained
FROM customer, unnest(['row_order_shuffle', 'non_observation_row_injection', 'decoy_feature_pack_injection']) t(o)""")
def one_target_selection(s, d):
    names = F.explode(F.array(*[F.lit(x) for x in ("row_order_shuffle", *st.ONE_TARGET)]))
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("sample"), names.alias("operator"), F.array(F.lit("a.csv"), F.lit("b.csv")).alias("files"), F.slice(F.array(F.lit("x"), F.lit("y")), 1, (F.col("c_custkey") % 3).cast("int")).alias("sheets"))
    return st.one_target(rows).select("sample", "operator", F.size("files").alias("n_files"), F.size("sheets").alias("n_sheets"), "constrained")


@query("""SELECT c_custkey AS sample, c_custkey % 5 = 0 AS accepted, CASE c_custkey % 5 WHEN 1 THEN 'missing_final_files' WHEN 2 THEN 'file_manifest_mismatch' WHEN 3 THEN 'integrity_failed' WHEN 4 THEN 'attack_not_changed' END AS failed FROM customer""")
def constructed_file_gate(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("sample"), (F.col("c_custkey") % 5).alias("k"))
    original = c.select("sample", F.lit("a.csv").alias("file"), F.lit("1").alias("sha256"))
    final = c.select("sample", F.lit("a.csv").alias("file"), F.when(F.col("k") == 4, "1").otherwise("2").alias("sha256")).unionByName(c.filter("k = 2").select("sample", F.lit("b.csv").alias("file"), F.lit("3").alias("sha256")))
    declared = c.select("sample", F.lit("a.csv").alias("file")).unionByName(c.filter("k = 1").select("sample", F.lit("gone.csv").alias("file")))
    return st.file_gate(declared, final, original, c.filter("k = 3").select("sample"))
