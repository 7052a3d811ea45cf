"""Sheet structure and cells before and after a perturbation, as issues with codes.

Grids are cells (file, sheet, row, col, vtype, value and maybe formula, style); sheets are the rows of
sources.grid.workbook_structure. An issue is (file, sheet, code, n): how often a rule is broken in a sheet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import has_text

#: Least share of columns that must move, and issues listed at most in a report.
COLUMNS_MOVED, MAX_ISSUES = 0.6, 12
#: Operators that may change a sheet's size, its filters and tables, and those whose headers must keep their style.
ROW_INJECTION = ("non_observation_row_injection",)
MAY_RESIZE = ("semantic_distractor_column", "excel_hierarchical_header_relayout", "decoy_feature_pack_injection", *ROW_INJECTION)
MAY_MOVE_RANGES = ("semantic_distractor_column", "excel_hierarchical_header_relayout", *ROW_INJECTION)
KEEP_HEADER_STYLE = ("equivalent_value_reencoding", "unit_scale_conversion", *ROW_INJECTION)
ONE_TARGET = ("decoy_feature_pack_injection", "non_observation_row_injection")
_SHEET = ["file", "sheet"]


def token(grid: DataFrame) -> Column:
    """Type, value, formula, style and number format of a cell as one text."""
    parts = [F.col(c) for c in ("vtype", "value", "formula", "style", "format") if c in grid.columns]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def active_width(grid: DataFrame) -> DataFrame:
    """file, sheet, width: the last column of the first row that has text, 0 where none has."""
    return grid.groupBy(*_SHEET).agg(F.coalesce(F.max(F.when((F.col("row") == 1) & has_text(F.col("value")), F.col("col"))), F.lit(0)).cast("int").alias("width"))


def cell_pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, sheet, row, col, old, new (values), old_token, new_token of each place that has a cell before or after."""
    keys = [*_SHEET, "row", "col"]
    a = before.select(*keys, F.col("value").alias("old"), token(before).alias("old_token"))
    b = after.select(*keys, F.col("value").alias("new"), token(after).alias("new_token"))
    return a.join(b, keys, "full")


def changed_cells(before: DataFrame, after: DataFrame) -> DataFrame:
    """The places of cell_pairs whose cells differ in any part."""
    return cell_pairs(before, after).filter(~F.col("old_token").eqNullSafe(F.col("new_token")))


def _heads(grid: DataFrame) -> DataFrame:
    """file, sheet, col, name of the cells of the first row up to its active width."""
    width = active_width(grid)
    return grid.filter("row = 1").join(width, _SHEET).filter("col <= width").select(*_SHEET, "col", F.coalesce("value", F.lit("")).alias("name"))


def column_pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, sheet, name, old_col, new_col, same: columns that stand under one header before and after, and whether all their cells agree."""
    a, b = _heads(before).withColumnRenamed("col", "old_col"), _heads(after).withColumnRenamed("col", "new_col")
    both = a.join(b, [*_SHEET, "name"])
    keys = [*_SHEET, "name", "row"]
    old = before.withColumnRenamed("col", "old_col").join(both, [*_SHEET, "old_col"]).select(*keys, token(before).alias("old_token"))
    new = after.withColumnRenamed("col", "new_col").join(both, [*_SHEET, "new_col"]).select(*keys, token(after).alias("new_token"))
    differ = old.join(new, keys, "full").filter(~F.col("old_token").eqNullSafe(F.col("new_token"))).select(*_SHEET, "name").distinct().withColumn("differs", F.lit(True))
    return both.join(differ, [*_SHEET, "name"], "left").select(*_SHEET, "name", "old_col", "new_col", F.col("differs").isNull().alias("same"))


def _issue(rows: DataFrame, code: str, n: Column | None = None) -> DataFrame:
    return rows.groupBy(*_SHEET).agg((F.count("*") if n is None else n).alias("n")).filter("n > 0").select(*_SHEET, F.lit(code).alias("code"), "n")


def _all(issues: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def column_shuffle_issues(before: DataFrame, after: DataFrame) -> DataFrame:
    """Issues of a column shuffle: the header region, columns beside it, repeated or other headers, columns whose content changed, and too few moves."""
    a, b = active_width(before).withColumnRenamed("width", "old_width"), active_width(after).withColumnRenamed("width", "new_width")
    widths = a.join(b, _SHEET)
    whole = widths.filter("old_width = new_width AND old_width >= 2")
    beside = changed_cells(before, after).join(whole, _SHEET).filter("col > old_width")
    heads = lambda g, old: _heads(g).groupBy(*_SHEET).agg(F.array_sort(F.collect_list("name")).alias(old), (F.count("*") - F.count_distinct("name")).alias(f"{old}_again"))  # noqa: E731 (the headers of one sheet)
    names = heads(before, "was").join(heads(after, "is"), _SHEET).join(whole.select(*_SHEET), _SHEET)
    sets = names.filter("was_again = 0 AND is_again = 0")
    fair = sets.filter("was = is").select(*_SHEET)
    pairs = column_pairs(before, after).join(fair, _SHEET)
    weak = pairs.groupBy(*_SHEET).agg(F.count_if(F.col("old_col") != F.col("new_col")).alias("moved"), F.count("*").alias("all")).filter(F.col("moved") < COLUMNS_MOVED * F.col("all"))
    return _all([
        _issue(widths.filter("old_width <> new_width OR old_width < 2"), "header_region_changed"), _issue(beside.select(*_SHEET, "col").distinct(), "non_table_column_changed"), _issue(names.filter("was_again > 0 OR is_again > 0"), "duplicate_headers"),
        _issue(sets.filter("was <> is"), "header_set_changed"), _issue(pairs.filter("NOT same"), "column_content_changed"), _issue(weak, "column_shuffle_too_weak"),
    ])


def header_synonym_issues(before: DataFrame, after: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Issues of renamed headers: a changed text that isn't declared, another cell that changed, nothing renamed, and pairs that differ from the declared ones."""
    spark = before.sparkSession
    wanted = spark.createDataFrame(sorted(declared.items()), "old string, wanted string")
    pairs = cell_pairs(before, after)
    renamed = pairs.filter(~F.col("old").eqNullSafe(F.col("new"))).join(F.broadcast(wanted), "old", "left")
    undeclared = renamed.filter(~F.coalesce(F.col("wanted") == F.col("new"), F.lit(False)))
    other = pairs.filter(F.col("old").eqNullSafe(F.col("new")) & ~F.col("old_token").eqNullSafe(F.col("new_token")))
    sheets = before.select(*_SHEET).distinct()
    actual = renamed.select(*_SHEET, "old", "new").distinct()
    missed = sheets.crossJoin(F.broadcast(wanted)).join(actual, [*_SHEET, "old"], "left").filter(~F.coalesce(F.col("new") == F.col("wanted"), F.lit(False)))  # a few declared pairs
    extra = undeclared.select(*_SHEET, "old", "new").distinct()
    return _all([
        _issue(undeclared, "undeclared_header_change"), _issue(other, "non_header_cell_changed"), _issue(sheets.join(renamed.select(*_SHEET).distinct(), _SHEET, "left_anti"), "no_header_renamed"),
        _issue(missed.select(*_SHEET).unionByName(extra.select(*_SHEET)), "header_mapping_mismatch"),
    ])


def relayout_issues(before: DataFrame, after: DataFrame, starts: DataFrame) -> DataFrame:
    """Issues of a header relayout: data cells, counted from the first data row, that differ, other numbers of data rows or columns, other formulas, and no declared start.

    starts: file, sheet, old_start, new_start.
    """
    keys = [*_SHEET, "offset", "col"]
    old = before.join(starts, _SHEET).filter("row >= old_start").select(*_SHEET, (F.col("row") - F.col("old_start")).alias("offset"), "col", token(before).alias("old_token"))
    new = after.join(starts, _SHEET).filter("row >= new_start").select(*_SHEET, (F.col("row") - F.col("new_start")).alias("offset"), "col", token(after).alias("new_token"))
    sizes = lambda g, n: g.groupBy(*_SHEET).agg(F.max("row").alias(f"{n}_rows"), F.max("col").alias(f"{n}_cols"))
    both = sizes(before, "old").join(sizes(after, "new"), _SHEET).join(starts, _SHEET, "left")
    count = lambda n: F.greatest(F.col(f"{n}_rows") - F.col(f"{n}_start") + 1, F.lit(0))
    cells = old.join(new, keys, "full").join(both.withColumn("common", F.least(count("old"), count("new"))), _SHEET).filter("offset < common AND col <= least(old_cols, new_cols)")
    issues = [
        _issue(both.filter("old_start IS NULL OR new_start IS NULL"), "header_relayout_spec_missing"), _issue(both.filter("old_start IS NOT NULL AND old_cols <> new_cols"), "data_column_count_changed"),
        _issue(both.filter(count("old") != count("new")), "data_row_count_changed"), _issue(cells.filter(~F.col("old_token").eqNullSafe(F.col("new_token"))), "data_cell_changed"),
    ]
    if "formula" in before.columns and "formula" in after.columns:
        formulas = lambda g, n: g.filter("formula IS NOT NULL").groupBy(*_SHEET, "formula").agg(F.count("*").alias(n))
        issues.append(_issue(formulas(before, "a").join(formulas(after, "b"), [*_SHEET, "formula"], "full").filter(~F.col("a").eqNullSafe(F.col("b"))), "formula_set_changed"))
    return _all(issues)


def sheet_issues(before: DataFrame, after: DataFrame, operator: str) -> DataFrame:
    """Issues of a sheet's frame: size, merged ranges, filters, tables, hidden rows and columns, header styles; each where the operator must leave it alone.

    before and after: file, sheet, rows, cols, merges, filter_ref, tables, hidden_rows, hidden_cols, header_styles, and maybe position (of the sheet in its file). A sheet that
    only one side has, or that stands elsewhere, breaks sheet_names_changed; its other parts are not compared. Moving records between sheets may change them.
    """
    fields = ["rows", "cols", "merges", "filter_ref", "tables", "hidden_rows", "hidden_cols", "header_styles"]
    a = before.select(*_SHEET, *[F.col(f).alias(f"a_{f}") for f in fields])
    both = a.join(after.select(*_SHEET, *[F.col(f).alias(f"b_{f}") for f in fields]), _SHEET)
    place = "position" if "position" in before.columns and "position" in after.columns else None
    at = lambda t, c: t.select(*_SHEET, (F.col(place) if place else F.lit(0)).alias(c))
    moved = at(before, "was").join(at(after, "is"), _SHEET, "full").filter(F.lit(operator != "excel_cross_sheet_relayout") & ~F.col("was").eqNullSafe(F.col("is")))
    differs = lambda f: ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))
    in_order = lambda f: ~F.array_sort(f"a_{f}").eqNullSafe(F.array_sort(f"b_{f}"))
    common = F.least(F.size("a_header_styles"), F.size("b_header_styles"))
    relayout = operator == "excel_hierarchical_header_relayout"
    rules = {
        "sheet_shape_changed": (operator not in MAY_RESIZE, differs("rows") | differs("cols")),
        "merged_ranges_changed": (not relayout, in_order("merges")),
        "header_hierarchy_not_changed": (relayout, ~in_order("merges")),
        "filter_changed": (operator not in MAY_MOVE_RANGES, differs("filter_ref")),
        "table_range_changed": (operator not in MAY_MOVE_RANGES, in_order("tables")),
        "hidden_rows_changed": (operator != "row_order_shuffle", in_order("hidden_rows")),
        "hidden_columns_changed": (operator != "column_order_shuffle", in_order("hidden_cols")),
        "header_style_changed": (operator in KEEP_HEADER_STYLE, F.slice("a_header_styles", F.lit(1), common) != F.slice("b_header_styles", F.lit(1), common)),
    }
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, (applies, rule) in rules.items() if applies]))
    found = both.select(*_SHEET, F.explode(broken).alias("code")).unionByName(moved.select(*_SHEET, F.lit("sheet_names_changed").alias("code")))
    return found.withColumn("n", F.lit(1).cast("long"))


def issue_report(issues: DataFrame, files: DataFrame) -> DataFrame:
    """file, passed, n_issues, issues: for each of `files` (file) the first MAX_ISSUES of its issues by sheet and code, as sheet:code:n."""
    rank = F.row_number().over(Window.partitionBy("file").orderBy("sheet", "code"))  # at most one row a sheet and code
    said = F.concat_ws(":", "sheet", "code", F.col("n").cast("string"))
    listed = issues.withColumn("rank", rank).groupBy("file").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("rank") <= MAX_ISSUES, F.struct("rank", said.alias("said"))))).alias("list"))
    return files.join(listed, "file", "left").select("file", F.col("n").isNull().alias("passed"), F.coalesce("n", F.lit(0).cast("long")).alias("n_issues"), F.coalesce(F.array_join(F.col("list")["said"], ", "), F.lit("")).alias("issues"))


def one_target(selections: DataFrame) -> DataFrame:
    """Selections (sample, operator, files, sheets) with constrained: operators that work on one place keep their first file and sheet only."""
    local = F.col("operator").isin(*ONE_TARGET)
    many = local & ((F.size("files") > 1) | (F.size("sheets") > 1))
    cut = lambda c: F.when(local, F.slice(c, 1, 1)).otherwise(F.col(c)).alias(c)
    rest = [c for c in selections.columns if c not in ("files", "sheets")]
    return selections.select(*rest, cut("files"), cut("sheets"), F.coalesce(many, F.lit(False)).alias("constrained"))


def file_gate(declared: DataFrame, final: DataFrame, original: DataFrame, issues: DataFrame) -> DataFrame:
    """sample, accepted, failed: the first of missing_final_files, file_manifest_mismatch, integrity_failed and attack_not_changed.

    declared: sample, file (as the result names its inputs); final and original: sample, file, sha256; issues: sample of each broken rule.
    """
    names = declared.select("sample", "file").distinct().join(final.select("sample", "file", "sha256"), ["sample", "file"], "left")
    missing = names.groupBy("sample").agg(F.count_if(F.col("sha256").isNull()).alias("missing"))
    extra = final.join(declared.select("sample", "file"), ["sample", "file"], "left_anti").groupBy("sample").agg(F.count("*").alias("extra"))
    now = original.select("sample", "file", F.col("sha256").alias("was")).join(final.select("sample", "file", F.col("sha256").alias("is")), ["sample", "file"], "full")
    changes = now.groupBy("sample").agg(F.count_if(~F.col("was").eqNullSafe(F.col("is"))).alias("changes"))
    broken = issues.groupBy("sample").agg(F.count("*").alias("broken"))
    rows = missing.join(extra, "sample", "left").join(changes, "sample", "left").join(broken, "sample", "left").fillna(0, ["extra", "changes", "broken"])
    failed = F.when(F.col("missing") > 0, "missing_final_files").when(F.col("extra") > 0, "file_manifest_mismatch").when(F.col("broken") > 0, "integrity_failed").when(F.col("changes") == 0, "attack_not_changed")
    return rows.select("sample", failed.isNull().alias("accepted"), failed.alias("failed"))
