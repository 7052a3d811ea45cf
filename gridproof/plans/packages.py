"""Queries of whole packages: a thousand packages of orders, each perturbed by one operator, a third of them undamaged, with the issues that SQL expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packages as pk
from ..operators.intervals import cover
from ..sources.shared import written
from .fixtures import table
from .registry import query

OPERATORS = [pk.ROW_SHUFFLE, pk.COLUMN_SHUFFLE, pk.SYNONYM, pk.DISTRACTOR, pk.REENCODING, pk.UNIT, pk.DECOY, pk.NON_OBSERVATION, pk.CROSS_SHEET]
COLUMNS = ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate"]


def _rows(s: SparkSession, d: str) -> DataFrame:
    """Orders with their package p, operator number k, damage (0: none), place i and number n of rows in the package; bad: every seventh key."""
    rows = table(s, d, "orders").selectExpr("o_custkey % 1000 AS p", "o_orderkey", "o_totalprice", "o_orderstatus", "cast(cast(o_orderdate AS date) AS string) AS o_orderdate")
    return rows.selectExpr("*", f"p % {len(OPERATORS)} AS k", f"floor(p / {len(OPERATORS)}) % 3 AS damage", "row_number() OVER (PARTITION BY p ORDER BY o_orderkey) AS i", "count(*) OVER (PARTITION BY p) AS n", "o_orderkey % 7 = 0 AS bad")


def _cells(rows: DataFrame, side: str, columns: list[tuple[str, str, str, str]], row: str = "i + 1") -> DataFrame:
    """Cells of (col, vtype, value, where) expressions."""
    cells = [f"struct(cast({c} AS int) AS col, '{t}' AS vtype, cast({v} AS string) AS value, {w} AS here)" for c, t, v, w in columns]
    flat = rows.selectExpr("p", "k", f"cast({row} AS int) AS row", "file", "sheet", f"explode(array({', '.join(cells)})) AS c").filter("c.here")
    return flat.selectExpr("cast(p AS string) AS package", f"'{side}' AS side", "file", "sheet", "row", "c.col", "c.vtype", "c.value", "cast(null AS string) AS formula", "if(row = 1, 'h', null) AS style")


def _packages(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, pk.Contracts]:
    rows = written(_rows(s, d), "rows")
    base = rows.withColumn("file", F.expr("if(k = 8, 'book.xlsx', 'orders.csv')")).withColumn("sheet", F.expr("if(k = 8, 'all', '')"))
    plain = [("1", "bigint", "o_orderkey", "true"), ("2", "double", "o_totalprice", "true"), ("3", "string", "o_orderstatus", "true"), ("4", "string", "o_orderdate", "true")]
    one = written(base.filter("i = 1"), "first_rows")
    head = [(str(i + 1), "string", f"'{c}'", "true") for i, c in enumerate(COLUMNS)]
    before = _cells(base, "before", plain).unionByName(_cells(one, "before", head, "1"))
    # after: headers and values by operator and damage
    moved = base.withColumn("file", F.expr("if(p % 50 = 49, 'other.csv', file)")).withColumn("sheet", F.expr("if(k = 8 AND damage < 2, concat('s', o_orderstatus), sheet)"))
    turned = moved.withColumn("at", F.expr("CASE WHEN k = 0 AND damage < 2 THEN n + 2 - i WHEN k = 8 AND damage < 2 THEN 1 + row_number() OVER (PARTITION BY p, o_orderstatus ORDER BY o_orderkey) ELSE i + 1 END"))
    kept = turned.filter("NOT (k = 4 AND damage = 1 AND i = n)")
    shift = "CASE k WHEN 1 THEN {c} % 4 + 1 WHEN 3 THEN if(damage < 2 AND {c} > 2, {c} + 1, {c}) WHEN 8 THEN if(damage < 2, 5 - {c}, {c}) ELSE {c} END"
    status = "if(bad AND (k IN (0, 1, 8) AND damage = 1 OR k IN (2, 4) AND damage = 2), concat(o_orderstatus, '!'), o_orderstatus)"
    price = "CASE WHEN k = 5 THEN o_totalprice * if(damage = 1 AND bad, 1000, 100) ELSE o_totalprice END"
    date = "if(k = 4, replace(o_orderdate, '-', '/'), o_orderdate)"
    gross = "if(damage = 1, 'n/a', cast(round(o_totalprice * 1.1, 2) AS string))"
    forecast = "if(damage = 2, 'x', cast(round(o_totalprice * 1.1, 2) AS string))"
    some = "(damage <> {d} OR o_orderkey % 4 = 0)"
    body = [
        (shift.format(c=1), "bigint", "o_orderkey", "true"), (shift.format(c=2), "double", price, "true"), (shift.format(c=3), "string", status, "true"), (shift.format(c=4), "string", date, "true"),
        ("if(damage < 2, 3, 5)", "double", gross, f"k = 3 AND {some.format(d=2)}"), ("5", "double", forecast, f"k = 6 AND {some.format(d=1)}"), ("6", "string", "lower(o_orderstatus)", "k = 6"), ("5", "string", "'observation'", "k = 7"),
    ]
    names = [
        (shift.format(c=1), "string", "'o_orderkey'", "true"), (shift.format(c=2), "string", "CASE WHEN k = 2 THEN 'order_value' WHEN k = 5 AND damage < 2 THEN 'o_totalprice (cents)' ELSE 'o_totalprice' END", "true"),
        (shift.format(c=3), "string", "if(k = 1 AND damage = 2, 'status', 'o_orderstatus')", "true"), (shift.format(c=4), "string", "'o_orderdate'", "true"),
        ("if(damage < 2, 3, 5)", "string", "'o_totalprice_gross'", "k = 3"), ("5", "string", "'o_totalprice_forecast'", "k = 6"), ("6", "string", "'o_status_code'", "k = 6"), ("5", "string", "'record_type'", "k = 7"),
    ]
    heads = moved.withColumn("first", F.expr("row_number() OVER (PARTITION BY p, sheet ORDER BY o_orderkey)")).filter("first = 1")
    extra = moved.filter("k = 7 AND i = 1").withColumn("extra", F.explode(F.expr("array(1, 2)")))
    summary = [("1", "bigint", "extra", "true"), ("2", "double", "if(damage = 2, 'total', '0.5')", "true"), ("3", "string", "'S'", "true"), ("4", "string", "'1999-01-01'", "true"), ("5", "string", "if(damage = 2 AND extra = 2, 'other', 'summary')", "true")]
    after = _cells(kept, "after", body, "at").unionByName(_cells(heads, "after", names, "1")).unionByName(_cells(extra, "after", summary, "n + 1 + extra"))
    packages = one.selectExpr("cast(p AS string) AS package", f"element_at(array({', '.join(repr(o) for o in OPERATORS)}), cast(k + 1 AS int)) AS operator")
    of = lambda k: one.filter(f"k = {k}")
    new = "if(damage = 1, 'value', 'order_value')"
    contracts = pk.Contracts(
        renames=of(2).selectExpr("cast(p AS string) AS package", "'o_totalprice' AS old", f"{new} AS new"),
        bindings=of(2).selectExpr("cast(p AS string) AS package", "'o_totalprice' AS target_field", f"{new} AS transformed_field", "'price' AS question_concept", "if(damage = 2, ' ', 'what it costs') AS question_evidence"),
        audits=of(2).selectExpr("cast(p AS string) AS package", "'o_totalprice' AS old_header", f"{new} AS new_header", "true AS equivalent", "damage = 2 AS can_coexist", "'same column' AS evidence"),
        distractors=of(3).selectExpr("cast(p AS string) AS package", "'o_totalprice' AS target_field", "'o_totalprice_gross' AS distractor_field", "array('price', 'quote', 'net only', 'recompute', '12') AS texts"),
        packs=of(6).selectExpr("cast(p AS string) AS package", "file", "sheet", "1 AS header_row", "'17' AS misuse_answer", "array('o_totalprice') AS target_fields"),
        features=of(6).selectExpr("cast(p AS string) AS package", "explode(array(named_struct('o', 1, 'n', 'o_totalprice_forecast', 's', 'o_totalprice'), named_struct('o', 2, 'n', 'o_status_code', 's', 'o_orderstatus'))) AS f").selectExpr("package", "f.o AS ordinal", "f.n AS name", "f.s AS source_field", "'forecast' AS noise_subtype", "'no fact' AS exclusion_reason"),
        rows=of(7).withColumn("r", F.explode(F.expr("if(damage = 1, array(named_struct('a', n + 2, 'b', n + 2), named_struct('a', n + 2, 'b', n + 2)), array(named_struct('a', n + 2, 'b', n + 3)))"))).selectExpr("cast(p AS string) AS package", "file", "sheet", "cast(r.a AS int) AS row_start", "cast(r.b AS int) AS row_end", "'record_type' AS marker_field", "'summary' AS marker_value", "'summary_row' AS noise_subtype", "'no order' AS exclusion_reason", "'17' AS misuse_answer"),
        markers=of(7).selectExpr("cast(p AS string) AS package", "'record_type' AS name", "'observation' AS observation_value"),
    )
    return before.unionByName(after), packages, contracts


_ORACLE = """
WITH numbered AS (
  SELECT o_custkey % 1000 AS p, o_orderkey, o_orderstatus AS st, o_orderkey % 7 = 0 AS bad, row_number() OVER (PARTITION BY o_custkey % 1000 ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey % 1000) AS n FROM orders
),
facts AS (
  SELECT p, p % 9 AS k, (p // 9) % 3 AS d, max(n) AS n, count(*) FILTER (bad) AS m, count(DISTINCT st) FILTER (bad) AS bad_st, count(DISTINCT st) AS sts, count(*) FILTER (o_orderkey % 4 = 0) AS part4,
    count(*) FILTER (NOT (2 * i = n + 1 AND NOT ((p // 9) % 3 = 1 AND bad))) AS moved
  FROM numbered GROUP BY p
),
issues AS (
  SELECT p, k, 'file_package_changed' AS code, 2.0 AS value FROM facts WHERE p % 50 = 49
  UNION ALL SELECT p, k, code, value FROM facts, LATERAL (
    SELECT 'data_row_multiset_changed' AS code, 2.0 * m AS value WHERE k = 0 AND d = 1 AND m > 0
    UNION ALL SELECT 'row_shuffle_too_weak', CASE WHEN d = 2 THEN 0.0 ELSE round(moved / n, 6) END WHERE k = 0 AND (d = 2 OR moved / n < 0.8)
    UNION ALL SELECT 'attack_not_changed', 0.0 WHERE k = 0 AND (d = 2 OR moved = 0) OR k = 4 AND d = 1 OR k = 8 AND d = 2
    UNION ALL SELECT 'column_content_changed', 1.0 WHERE k = 1 AND d = 1 AND m > 0
    UNION ALL SELECT 'header_set_changed', 2.0 WHERE k = 1 AND d = 2
    UNION ALL SELECT 'undeclared_header_change', CASE WHEN d = 1 THEN 1.0 ELSE m END WHERE k = 2 AND (d = 1 OR d = 2 AND m > 0)
    UNION ALL SELECT 'header_mapping_mismatch', CASE WHEN d = 1 THEN 2.0 ELSE bad_st END WHERE k = 2 AND (d = 1 OR d = 2 AND m > 0)
    UNION ALL SELECT unnest(['field_binding_evidence_missing', 'synonym_audit_failed']), 1.0 WHERE k = 2 AND d = 2
    UNION ALL SELECT 'distractor_type_incompatible', 1.0 WHERE k = 3 AND d = 1
    UNION ALL SELECT 'distractor_not_adjacent', 3.0 WHERE k = 3 AND d = 2
    UNION ALL SELECT 'distractor_coverage_too_low', round(part4 / n, 6) WHERE k = 3 AND d = 2 AND part4 / n < 0.5
    UNION ALL SELECT 'distractor_difference_too_low', 0.0 WHERE k = 3 AND d = 2 AND part4 = 0
    UNION ALL SELECT 'sheet_shape_changed', 1.0 WHERE k = 4 AND d = 1
    UNION ALL SELECT 'reencoding_not_equivalent', m::DOUBLE WHERE k = 4 AND d = 2 AND m > 0
    UNION ALL SELECT 'unit_factor_inconsistent', 1.0 WHERE k = 5 AND d = 1 AND m BETWEEN 1 AND n - 1
    UNION ALL SELECT 'unit_conversion_incomplete', 1.0 WHERE k = 5 AND d = 2
    UNION ALL SELECT 'feature_pack_sparse', 1.0 WHERE k = 6 AND d = 1 AND part4 < 0.6 * n
    UNION ALL SELECT 'feature_type_incompatible', 1.0 WHERE k = 6 AND d = 2
    UNION ALL SELECT 'non_observation_row_declaration_mismatch', 2.0 WHERE k = 7 AND d = 1
    UNION ALL SELECT unnest(['injected_row_type_incompatible', 'non_observation_marker_invalid']), 1.0 WHERE k = 7 AND d = 2
    UNION ALL SELECT 'cross_sheet_records_changed', 2.0 * m WHERE k = 8 AND d = 1 AND m > 0
    UNION ALL SELECT 'sheet_count_not_changed', 1.0 WHERE k = 8 AND (d = 2 OR sts = 1)
  ) WHERE p % 50 <> 49
)
"""
_NAMES = f"[{', '.join(repr(o) for o in OPERATORS)}]"


@query(f"{_ORACLE} SELECT p::VARCHAR AS package, {_NAMES}[k + 1] AS operator, code, value::DOUBLE AS value FROM issues")
def package_integrity_issues(s: SparkSession, d: str) -> DataFrame:
    return pk.package_issues(*_packages(s, d)).select("package", "operator", "code", "value")


@query("""
WITH lines AS (SELECT l_orderkey AS key, l_linenumber AS i, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem),
wanted AS (SELECT key, 1 AS lo, max(r) * 10 AS hi FROM lines GROUP BY key),
ranges AS (SELECT key, (r - 1) * 10 + 1 AS a, r * 10 + CASE WHEN part % 5 = 0 THEN 3 WHEN part % 5 = 1 THEN -2 ELSE 0 END AS b FROM lines),
places AS (SELECT key, pos, count(*) AS n FROM (SELECT key, unnest(range(a, b + 1)) AS pos FROM ranges) GROUP BY key, pos)
SELECT w.key, (hi - lo + 1 - coalesce(sum(CASE WHEN pos BETWEEN lo AND hi THEN 1 ELSE 0 END), 0))::BIGINT AS never, coalesce(sum(CASE WHEN pos BETWEEN lo AND hi THEN n - 1 ELSE 0 END), 0)::BIGINT AS again, coalesce(sum(CASE WHEN pos > hi THEN n ELSE 0 END), 0)::BIGINT AS outside
FROM wanted w LEFT JOIN places p ON w.key = p.key GROUP BY w.key, hi, lo
""")
def declared_range_cover(s: SparkSession, d: str) -> DataFrame:
    """Ranges of ten places a line, some too long, some too short, against the places that an order has."""
    lines = table(s, d, "lineitem").selectExpr("l_orderkey AS key", "l_partkey AS part", "cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS long) AS r")
    ranges = lines.selectExpr("key", "(r - 1) * 10 + 1 AS start", "r * 10 + CASE WHEN part % 5 = 0 THEN 3 WHEN part % 5 = 1 THEN -2 ELSE 0 END AS end")
    wanted = lines.groupBy("key").agg(F.lit(1).cast("long").alias("start"), (F.max("r") * 10).alias("end"))
    return cover(ranges, wanted, ["key"])
