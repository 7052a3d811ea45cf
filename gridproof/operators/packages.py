"""Validators of perturbed packages: many packages, all operators, one plan.

Cells of all packages lie in one table (package, side: before or after, file, sheet, row, col, vtype, value, formula, style), and what a package
declares about itself in contract tables keyed by package. Facts about sheets are grouped aggregates, in long form (package, operator, file, sheet, fact, value); a rule
is a row of RULES that names a fact and the values that break it. So the number of jobs does not depend on the number of packages, and a large
sheet is shared out by its cells. sheet is empty for delimited files, whose values are judged by their text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parse import family, has_text, is_close, parse_plain_number, values_equivalent
from ..sources.shared import written
from .intervals import cover

K = ["package", "file", "sheet"]
CELLS = "package string, side string, file string, sheet string, row int, col int, vtype string, value string, formula string, style string"

#: Names of the operators and the shares and counts that they have to keep.
ROW_SHUFFLE, COLUMN_SHUFFLE, SYNONYM, DISTRACTOR = "row_order_shuffle", "column_order_shuffle", "header_synonym_substitution", "semantic_distractor_column"
REENCODING, UNIT, DECOY, NON_OBSERVATION = "equivalent_value_reencoding", "unit_scale_conversion", "decoy_feature_pack_injection", "non_observation_row_injection"
CROSS_SHEET, DECOMPOSITION = "excel_cross_sheet_relayout", "csv_relational_decomposition"
ROWS_MOVED, COLUMNS_MOVED, REENCODED, DISTRACTOR_FILLED, DISTRACTOR_APART, DECOY_FILLED = 0.8, 0.6, 0.3, 0.5, 0.3, 0.6
SUBTYPES = ("summary_row", "sample_row", "simulated_row", "check_row", "control_row")
LABEL_ROWS = 8  # a unit's label stands in the first rows

#: Fixed values: (operators, code, fact, what breaks the rule, limit). An operator's facts exist only where its check gets that far.
RULES = [
    ("*", "file_package_changed", "files_differing", ">", 0), ("*", "attack_not_changed", "permitted_changes", "=", 0), ("*", "sheet_names_changed", "sheets_differing", ">", 0), ("*", "sheet_shape_changed", "shape_changed", ">", 0),
    (ROW_SHUFFLE, "header_changed", "header_cells_changed", ">", 0), (ROW_SHUFFLE, "data_row_multiset_changed", "rows_unmatched", ">", 0), (ROW_SHUFFLE, "row_shuffle_too_weak", "rows_moved_share", "<", ROWS_MOVED),
    (COLUMN_SHUFFLE, "duplicate_headers", "headers_repeated", ">", 0), (COLUMN_SHUFFLE, "header_set_changed", "headers_unmatched", ">", 0), (COLUMN_SHUFFLE, "column_content_changed", "columns_changed", ">", 0), (COLUMN_SHUFFLE, "column_shuffle_too_weak", "columns_moved_share", "<", COLUMNS_MOVED),
    (SYNONYM, "undeclared_header_change", "renames_undeclared", ">", 0), (SYNONYM, "header_style_changed", "renames_restyled", ">", 0), (SYNONYM, "non_header_cell_changed", "other_cells_changed", ">", 0), (SYNONYM, "no_header_renamed", "values_changed", "=", 0),
    (SYNONYM, "header_mapping_mismatch", "renames_unmatched", ">", 0), (SYNONYM, "synonym_mapping_count_invalid", "mapping_out_of_range", ">", 0), (SYNONYM, "field_bindings_invalid", "bindings_missing", ">", 0), (SYNONYM, "field_binding_evidence_missing", "bindings_without_evidence", ">", 0),
    (SYNONYM, "field_binding_mapping_mismatch", "bindings_unmatched", ">", 0), (SYNONYM, "synonym_audit_invalid", "audits_missing", ">", 0), (SYNONYM, "synonym_audit_failed", "audits_failed", ">", 0), (SYNONYM, "synonym_evidence_missing", "audits_without_evidence", ">", 0), (SYNONYM, "synonym_audit_mapping_mismatch", "audits_unmatched", ">", 0),
    (DISTRACTOR, "distractor_contract_incomplete", "contract_texts_missing", ">", 0), (DISTRACTOR, "distractor_matches_target", "distractor_is_target", ">", 0), (DISTRACTOR, "row_count_changed", "row_count_changed", ">", 0), (DISTRACTOR, "duplicate_headers", "headers_repeated", ">", 0),
    (DISTRACTOR, "original_column_missing", "headers_missing", ">", 0), (DISTRACTOR, "original_columns_reordered", "headers_out_of_order", ">", 0), (DISTRACTOR, "distractor_column_missing", "headers_added", "=", 0), (DISTRACTOR, "distractor_declaration_mismatch", "headers_undeclared", ">", 0),
    (DISTRACTOR, "distractor_not_adjacent", "distractor_distance", ">", 1), (DISTRACTOR, "original_cell_changed", "cells_changed_by_name", ">", 0), (DISTRACTOR, "distractor_coverage_too_low", "distractor_filled", "<", DISTRACTOR_FILLED),
    (DISTRACTOR, "distractor_type_incompatible", "distractor_families_apart", ">", 0), (DISTRACTOR, "distractor_difference_too_low", "distractor_apart", "<", DISTRACTOR_APART),
    (REENCODING, "missingness_changed", "missingness_changed", ">", 0), (REENCODING, "reencoding_not_equivalent", "values_inequivalent", ">", 0), (REENCODING, "reencoding_missing", "cells_changed", "=", 0), (REENCODING, "reencoding_too_weak", "reencoded_share", "<", REENCODED),
    (UNIT, "undeclared_unit_change", "cells_without_unit", ">", 0), (UNIT, "unit_conversion_incomplete", "unit_parts_missing", ">", 0), (UNIT, "unit_factor_inconsistent", "factors_apart", ">", 0),
    (DECOY, "feature_pack_missing", "pack_missing", ">", 0), (DECOY, "feature_pack_contract_incomplete", "contract_texts_missing", ">", 0), (DECOY, "feature_names_invalid", "feature_names_invalid", ">", 0), (DECOY, "feature_declaration_incomplete", "features_incomplete", ">", 0), (DECOY, "feature_pack_header_row_invalid", "header_row_invalid", ">", 0),
    (DECOY, "undeclared_sheet_changed", "undeclared_cells_changed", ">", 0), (DECOY, "feature_pack_shape_invalid", "shape_invalid", ">", 0), (DECOY, "original_records_changed", "original_cells_changed", ">", 0), (DECOY, "feature_pack_declaration_mismatch", "features_unmatched", ">", 0), (DECOY, "duplicate_headers", "headers_repeated", ">", 0),
    (DECOY, "feature_source_missing", "sources_missing", ">", 0), (DECOY, "feature_pack_sparse", "features_sparse", ">", 0), (DECOY, "feature_type_incompatible", "features_incompatible", ">", 0),
    (NON_OBSERVATION, "non_observation_rows_missing", "declarations_missing", ">", 0), (NON_OBSERVATION, "non_observation_declaration_incomplete", "declarations_incomplete", ">", 0), (NON_OBSERVATION, "undeclared_sheet_changed", "undeclared_cells_changed", ">", 0), (NON_OBSERVATION, "non_observation_shape_invalid", "shape_invalid", ">", 0),
    (NON_OBSERVATION, "original_records_changed", "original_cells_changed", ">", 0), (NON_OBSERVATION, "marker_column_header_invalid", "marker_header_invalid", ">", 0), (NON_OBSERVATION, "observation_marker_invalid", "observations_unmarked", ">", 0), (NON_OBSERVATION, "non_observation_row_declaration_mismatch", "rows_misdeclared", ">", 0),
    (NON_OBSERVATION, "non_observation_marker_missing", "marker_fields_missing", ">", 0), (NON_OBSERVATION, "non_observation_marker_invalid", "rows_mismarked", ">", 0), (NON_OBSERVATION, "injected_row_type_incompatible", "columns_incompatible", ">", 0), (NON_OBSERVATION, "non_observation_count_invalid", "count_invalid", ">", 0),
    (CROSS_SHEET, "cross_sheet_records_changed", "records_unmatched", ">", 0), (CROSS_SHEET, "sheet_count_not_changed", "sheet_count_kept", ">", 0), (CROSS_SHEET, "invalid_relayout_sheet", "sheets_invalid", ">", 0), (CROSS_SHEET, "formula_set_changed", "formulas_unmatched", ">", 0), (CROSS_SHEET, "header_style_changed", "header_styles_new", ">", 0),
]
MAY_RESIZE = (DISTRACTOR, DECOY, NON_OBSERVATION, CROSS_SHEET, "excel_hierarchical_header_relayout", DECOMPOSITION)


@dataclass
class Contracts:
    """What packages declare. A table that no package needs may be left out.

    renames: package, old, new. bindings: package, target_field, transformed_field, question_concept, question_evidence. audits: package, old_header, new_header, equivalent, can_coexist
    (booleans), evidence. distractors: package, target_field, distractor_field, texts (array of the other texts that are asked for). packs: package, file, sheet, header_row,
    misuse_answer, target_fields. features: package, ordinal (from 1), name, source_field, noise_subtype, exclusion_reason. rows: package, file, sheet, row_start, row_end, marker_field, marker_value,
    noise_subtype, exclusion_reason, misuse_answer. markers: package, name, observation_value.
    """

    renames: DataFrame | None = None
    bindings: DataFrame | None = None
    audits: DataFrame | None = None
    distractors: DataFrame | None = None
    packs: DataFrame | None = None
    features: DataFrame | None = None
    rows: DataFrame | None = None
    markers: DataFrame | None = None
    schemas: dict[str, str] = field(
        default_factory=lambda: {
            "renames": "package string, old string, new string",
            "bindings": "package string, target_field string, transformed_field string, question_concept string, question_evidence string",
            "audits": "package string, old_header string, new_header string, equivalent boolean, can_coexist boolean, evidence string",
            "distractors": "package string, target_field string, distractor_field string, texts array<string>",
            "packs": "package string, file string, sheet string, header_row int, misuse_answer string, target_fields array<string>",
            "features": "package string, ordinal int, name string, source_field string, noise_subtype string, exclusion_reason string",
            "rows": "package string, file string, sheet string, row_start int, row_end int, marker_field string, marker_value string, noise_subtype string, exclusion_reason string, misuse_answer string",
            "markers": "package string, name string, observation_value string",
        }
    )

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        found = getattr(self, name)
        return spark.createDataFrame([], self.schemas[name]) if found is None else found


FIELDS = ["vtype", "value", "formula", "style"]  # what a cell holds


def _token() -> Column:
    """A cell as one text: each field after its length, so no two cells have the same; null is a dash."""
    return F.concat(*[F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-")) for c in FIELDS])


def _kind(cell: str = "") -> Column:
    """blank, formula, boolean, date, number or text: by the text in delimited files, by the cell's type in sheets. cell: the struct that holds its fields, if any."""
    vtype, value, formula = (F.col(f"{cell}.{c}" if cell else c) for c in ("vtype", "value", "formula"))
    typed = F.when(vtype.isin("boolean", "date", "timestamp"), vtype).when(vtype.rlike("number|int|double|float|decimal|short|byte|long"), "number").otherwise("text")
    blank = value.isNull() | (value == "")
    return F.when(blank, "blank").when(formula.isNotNull(), "formula").when(F.col("sheet") == "", family(value)).otherwise(typed)


def _long(rows: DataFrame, facts: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """Facts of rows in long form; null facts don't exist."""
    keys = keys or ["operator", *K]
    place = [F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("package", "operator", "file", "sheet")]
    pairs = F.array(*[F.struct(F.lit(name).alias("fact"), x.cast("double").alias("value")) for name, x in facts.items()])
    return rows.select(*place, F.explode(pairs).alias("f")).select("package", "operator", "file", "sheet", "f.fact", "f.value").filter("value IS NOT NULL")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class _Grids:
    """What all checks share, each written once: cells with their operator, extents, headers, and cells matched by place."""

    def __init__(self, cells: DataFrame, packages: DataFrame):
        self.cells = written(cells.join(packages.select("package", "operator"), "package"), "cells")
        self.keys = ["operator", *K]
        before, after = F.col("side") == "before", F.col("side") == "after"
        size = lambda c, s, name: F.max(F.when(s, F.col(c))).alias(name)
        sheets = self.cells.groupBy(*self.keys).agg(size("row", before, "rows_before"), size("row", after, "rows_after"), size("col", before, "cols_before"), size("col", after, "cols_after"))
        self.sheets = written(sheets, "sheets")
        self.both = self.sheets.filter("rows_before IS NOT NULL AND rows_after IS NOT NULL")
        same = (F.col("rows_before") == F.col("rows_after")) & (F.col("cols_before") == F.col("cols_after"))
        self.same = self.both.filter(same)
        heads = self.cells.filter(F.col("row") == 1)
        widths = heads.groupBy(*self.keys, "side").agg(F.max(F.when(has_text(F.col("value")), F.col("col"))).alias("width"))
        self.heads = written(heads.join(widths, [*self.keys, "side"]).filter("col <= width").select(*self.keys, "side", "col", F.coalesce("value", F.lit("")).alias("name")), "heads")
        at = [*self.keys, "row", "col"]
        part = lambda s, p: F.max(F.when(s, F.struct(*FIELDS))).alias(p)
        read = ~F.col("operator").isin(COLUMN_SHUFFLE, DISTRACTOR, CROSS_SHEET, DECOMPOSITION) & ((F.col("operator") != ROW_SHUFFLE) | (F.col("row") == 1))  # all that any check reads by place
        placed = self.cells.filter(read).groupBy(*at).agg(part(before, "old"), part(after, "new")).withColumn("differs", ~F.col("old").eqNullSafe(F.col("new")))
        self.placed = written(placed, "placed")

    def side(self, name: str, *operators: str) -> DataFrame:
        return self.cells.filter((F.col("side") == name) & F.col("operator").isin(*operators))

    def of(self, *operators: str) -> DataFrame:
        return self.placed.filter(F.col("operator").isin(*operators))

    def by_name(self) -> DataFrame:
        """keys, name, old_col, new_col: headers of both sides, matched; a repeated header matches more than once."""
        pick = lambda s, c: self.heads.filter(F.col("side") == s).select(*self.keys, "name", F.col("col").alias(c))
        return pick("before", "old_col").join(pick("after", "new_col"), [*self.keys, "name"], "full")


def _package_facts(g: _Grids) -> DataFrame:
    files = g.sheets.groupBy("package", "operator", "file").agg(F.count("rows_before").alias("a"), F.count("rows_after").alias("b"), F.count("*").alias("n"))
    differing = files.groupBy("package", "operator").agg(F.count_if((F.col("a") == 0) != (F.col("b") == 0)).alias("differing")).filter(F.col("operator") != DECOMPOSITION)
    sheets = files.filter((F.col("a") > 0) & (F.col("b") > 0) & ~F.col("operator").isin(CROSS_SHEET, DECOMPOSITION))
    shape = g.both.filter(~F.col("operator").isin(*MAY_RESIZE)).withColumn("changed", (F.col("rows_before") != F.col("rows_after")) | (F.col("cols_before") != F.col("cols_after")))
    return _union([
        _long(differing, {"files_differing": F.col("differing")}, ["package", "operator"]), _long(sheets, {"sheets_differing": 2 * F.col("n") - F.col("a") - F.col("b")}, ["package", "operator", "file"]), _long(shape, {"shape_changed": F.col("changed").cast("int")}),
    ])


def _row_hashes(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, h1, h2: two sums of hashes over the cells of a row, so the order of cells does not matter and rows of different columns compare."""
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.col(name), _token()).cast("decimal(38, 0)"))
    return rows.groupBy(*keys).agg(hashed(1).alias("h1"), hashed(2).alias("h2"))


def _unmatched(rows: DataFrame, keys: list[str], what: list[str]) -> DataFrame:
    """keys, unmatched: by how much the multisets of `what` before and after differ."""
    counts = rows.groupBy(*keys, *what).agg(F.sum(F.when(F.col("side") == "before", 1).otherwise(-1)).alias("d"))
    return counts.groupBy(*keys).agg(F.sum(F.abs("d")).alias("unmatched"))


def _row_shuffle_facts(g: _Grids) -> DataFrame:
    cells = g.cells.filter(F.col("operator") == ROW_SHUFFLE).join(g.same.filter("rows_before >= 2"), g.keys)
    rows = _row_hashes(cells.filter("row > 1"), [*g.keys, "side", "row"], "col")
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.struct("h1", "h2"))).alias(c)
    moved = rows.groupBy(*g.keys, "row").agg(pick("before", "a"), pick("after", "b")).groupBy(*g.keys).agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("moved"), F.count("*").alias("n"))
    head = g.of(ROW_SHUFFLE).filter("row = 1").groupBy(*g.keys).agg(F.count_if("differs").alias("n")).join(g.same.select(*g.keys), g.keys)
    return _union([
        _long(_unmatched(rows, g.keys, ["h1", "h2"]), {"rows_unmatched": F.col("unmatched")}), _long(moved, {"rows_moved_share": F.round(F.col("moved") / F.col("n"), 6), "permitted_changes": F.col("moved")}), _long(head, {"header_cells_changed": F.col("n")}),
    ])


def _heading_facts(g: _Grids) -> DataFrame:
    """Headers of column shuffles, distractors and decoy packs, and the cells below equal headers."""
    operators = (COLUMN_SHUFFLE, DISTRACTOR)
    heads = g.heads.filter(F.col("operator").isin(*operators, DECOY))
    repeated = heads.groupBy(*g.keys, "side", "name").count().groupBy(*g.keys).agg(F.count_if(F.expr("count > 1")).alias("n"))
    fair = repeated.filter(F.col("operator").isin(*operators) & (F.col("n") == 0)).select(*g.keys).join(g.both.filter("rows_before = rows_after AND (operator <> 'column_order_shuffle' OR cols_before = cols_after)").select(*g.keys), g.keys)
    pairs = g.by_name().join(fair, g.keys)
    order = Window.partitionBy(*g.keys).orderBy("old_col")  # the columns of a sheet
    ordered = pairs.filter("old_col IS NOT NULL AND new_col IS NOT NULL").withColumn("before", F.lag("new_col").over(order))
    counts = pairs.groupBy(*g.keys).agg(F.count_if(F.expr("new_col IS NULL")).alias("missing"), F.count_if(F.expr("old_col IS NULL")).alias("added"), F.count_if(F.expr("old_col <> new_col")).alias("moved"), F.count("old_col").alias("n"))
    turned = ordered.groupBy(*g.keys).agg(F.count_if(F.expr("before > new_col")).alias("turned"))
    matched = ordered.select(*g.keys, "name", "old_col", "new_col")
    at = lambda s, c: g.side(s, *operators).withColumnRenamed("col", c).join(matched, [*g.keys, c]).select(*g.keys, "name", "row", F.lit(s).alias("side"), _token().alias("token"))
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("token")))
    cells = at("before", "old_col").unionByName(at("after", "new_col")).groupBy(*g.keys, "name", "row").agg(pick("before").alias("a"), pick("after").alias("b"))
    changed = cells.filter(~F.col("a").eqNullSafe(F.col("b"))).groupBy(*g.keys, "name").count().groupBy(*g.keys).agg(F.count("*").alias("columns"), F.sum("count").alias("cells"))
    shuffle = F.col("operator") == COLUMN_SHUFFLE
    unmatched = counts.filter(shuffle & (F.col("missing") + F.col("added") > 0)).select(*g.keys)
    return _union([
        _long(repeated, {"headers_repeated": F.col("n")}), _long(turned, {"headers_out_of_order": F.col("turned")}),
        _long(counts, {"headers_unmatched": F.col("missing") + F.col("added"), "headers_missing": F.col("missing"), "headers_added": F.col("added"), "columns_moved_share": F.when(shuffle & (F.col("missing") + F.col("added") == 0), F.round(F.col("moved") / F.col("n"), 6)), "permitted_changes": F.when(shuffle, F.col("moved")).otherwise(F.col("added"))}),
        _long(changed.join(unmatched, g.keys, "left_anti"), {"columns_changed": F.col("columns"), "cells_changed_by_name": F.col("cells")}),
        _long(g.both.filter((F.col("operator") == DISTRACTOR)), {"row_count_changed": (F.col("rows_before") != F.col("rows_after")).cast("int")}),
    ])


def _pairs_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """package, n: pairs (old, new) of a package that only one of two tables has."""
    marked = a.select("package", "old", "new", F.lit(1).alias("s")).distinct().unionByName(b.select("package", "old", "new", F.lit(-1).alias("s")).distinct())
    return marked.groupBy("package", "old", "new").agg(F.sum("s").alias("d")).groupBy("package").agg(F.count_if(F.expr("d <> 0")).alias("n"))


def _synonym_facts(g: _Grids, packages: DataFrame, c: dict[str, DataFrame]) -> DataFrame:
    mine = packages.filter(F.col("operator") == SYNONYM).select("package", "operator")
    wanted = c["renames"].select("package", F.col("old").alias("from"), F.col("new").alias("to"))
    cells = g.of(SYNONYM).join(g.same.select(*g.keys), g.keys).filter("differs").withColumn("from", F.coalesce("old.value", F.lit("None"))).withColumn("renamed", ~F.col("old.value").eqNullSafe(F.col("new.value")))
    joined = cells.join(wanted, ["package", "from"], "left")
    form = lambda s: F.to_json(F.when(F.col(s).isNotNull(), F.struct(f"{s}.vtype", f"{s}.formula", f"{s}.style")))
    undeclared = F.col("renamed") & ~F.coalesce(F.col("to") == F.col("new.value"), F.lit(False))
    counts = joined.groupBy(*g.keys).agg(F.count_if("renamed").alias("renamed"), F.count_if(undeclared).alias("undeclared"), F.count_if(F.col("renamed") & ~form("old").eqNullSafe(form("new"))).alias("restyled"), F.count_if(~F.col("renamed")).alias("other"))
    counts = g.same.filter(F.col("operator") == SYNONYM).select(*g.keys).join(counts, g.keys, "left").fillna(0)
    actual = cells.filter("renamed").select(*g.keys, F.col("from").alias("old"), F.col("new.value").alias("new")).distinct().withColumn("s", F.lit(1))
    declared = g.same.filter(F.col("operator") == SYNONYM).select(*g.keys).join(c["renames"].select("package", "old", "new"), "package").withColumn("s", F.lit(-1))
    off = actual.unionByName(declared).groupBy(*g.keys, "old", "new").agg(F.sum("s").alias("d")).groupBy(*g.keys).agg(F.count_if(F.expr("d <> 0")).alias("n"))
    b, a = c["bindings"], c["audits"]
    count = lambda t, n: t.groupBy("package").agg(F.count("*").alias(n))
    sizes = mine.join(count(c["renames"], "maps"), "package", "left").join(count(b, "binds"), "package", "left").join(count(a, "audits"), "package", "left").fillna(0)
    proof = b.groupBy("package").agg(F.count_if(~(has_text(F.col("question_concept")) & has_text(F.col("question_evidence")))).alias("n"))
    failed = a.groupBy("package").agg(F.count_if(~F.coalesce(F.col("equivalent") & ~F.col("can_coexist"), F.lit(False))).alias("failed"), F.count_if(~has_text(F.col("evidence"))).alias("bare"))
    per_package = ["package", "operator"]
    bound = _pairs_differ(c["renames"], b.select("package", F.col("target_field").alias("old"), F.col("transformed_field").alias("new")))
    audited = _pairs_differ(c["renames"], a.select("package", F.col("old_header").alias("old"), F.col("new_header").alias("new")))
    return _union([
        _long(counts, {"renames_undeclared": F.col("undeclared"), "renames_restyled": F.col("restyled"), "other_cells_changed": F.col("other"), "values_changed": F.col("renamed"), "permitted_changes": F.col("renamed")}), _long(off, {"renames_unmatched": F.col("n")}),
        _long(sizes, {"mapping_out_of_range": (~F.col("maps").between(1, 3)).cast("int"), "bindings_missing": (F.col("binds") != F.col("maps")).cast("int"), "audits_missing": (F.col("audits") != F.col("maps")).cast("int")}, per_package),
        _long(mine.join(proof, "package"), {"bindings_without_evidence": F.col("n")}, per_package), _long(mine.join(failed, "package"), {"audits_failed": F.col("failed"), "audits_without_evidence": F.col("bare")}, per_package),
        _long(mine.join(bound, "package"), {"bindings_unmatched": F.col("n")}, per_package), _long(mine.join(audited, "package"), {"audits_unmatched": F.col("n")}, per_package),
    ])


def _distractor_facts(g: _Grids, packages: DataFrame, contracts: DataFrame) -> DataFrame:
    mine = packages.filter(F.col("operator") == DISTRACTOR).select("package", "operator")
    declared = mine.join(contracts, "package", "left")
    lacking = F.coalesce(F.size(F.filter("texts", lambda t: ~has_text(t))), F.lit(1)) + (~has_text(F.col("target_field"))).cast("int") + (~has_text(F.col("distractor_field"))).cast("int")
    equal = F.coalesce(F.col("target_field") == F.col("distractor_field"), F.lit(False)).cast("int")
    sheets = g.both.filter((F.col("operator") == DISTRACTOR) & (F.col("rows_before") == F.col("rows_after"))).select(*g.keys)
    fields = sheets.join(contracts, "package")
    after = g.heads.filter("side = 'after'").select(*g.keys, "name", F.col("col").alias("at"))
    find = lambda f, c: fields.select(*g.keys, F.col(f).alias("name")).join(after, [*g.keys, "name"]).groupBy(*g.keys).agg(F.min("at").alias(c))
    places = find("target_field", "target").join(find("distractor_field", "distractor"), g.keys)
    new = g.by_name().filter("old_col IS NULL").join(sheets, g.keys).join(contracts.select("package", "distractor_field"), "package", "left")
    undeclared = new.groupBy(*g.keys).agg(F.count_if(~F.coalesce(F.col("name") == F.col("distractor_field"), F.lit(False))).alias("n"))
    cells = g.side("after", DISTRACTOR).filter("row > 1").join(places, g.keys).filter("col IN (target, distractor)").withColumn("kind", _kind())
    pick = lambda c, what: F.max(F.when(F.col("col") == F.col(c), F.col(what))).alias(f"{c}_{what}")
    rows = cells.groupBy(*g.keys, "row").agg(pick("target", "value"), pick("distractor", "value"), pick("target", "kind"), pick("distractor", "kind"))
    filled = lambda c: F.coalesce(F.col(f"{c}_kind") != "blank", F.lit(False))
    kinds = lambda c: F.collect_set(F.when(filled(c), F.col(f"{c}_kind"))).alias(f"{c}_kinds")  # noqa: E731 (six at most)
    both = filled("target") & filled("distractor")
    sums = rows.groupBy(*g.keys).agg(F.count_if(filled("target")).alias("t"), F.count_if(filled("distractor")).alias("d"), F.count_if(both).alias("both"), F.count_if(both & (F.col("target_value") != F.col("distractor_value"))).alias("apart"), kinds("target"), kinds("distractor"))
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.lit(1), F.col(b)), 6)
    disjoint = (F.size("target_kinds") > 0) & (F.size("distractor_kinds") > 0) & ~F.arrays_overlap("target_kinds", "distractor_kinds")
    return _union([
        _long(declared, {"contract_texts_missing": lacking, "distractor_is_target": equal}, ["package", "operator"]), _long(undeclared, {"headers_undeclared": F.col("n")}), _long(places, {"distractor_distance": F.abs(F.col("target") - F.col("distractor"))}),
        _long(sums, {"distractor_filled": share("d", "t"), "distractor_apart": share("apart", "both"), "distractor_families_apart": disjoint.cast("int")}),
    ])


def _value_facts(g: _Grids) -> DataFrame:
    """Re-encodings and unit conversions: cells of equal sheets, place by place."""
    cells = g.of(REENCODING, UNIT).join(g.same.select(*g.keys), g.keys).filter("differs")
    old, new = F.col("old.value"), F.col("new.value")
    kinds = lambda s: F.when(F.col(s).isNotNull(), _kind(s)).alias(f"{s}_kind")
    cells = cells.select("*", kinds("old"), kinds("new"))
    blank = lambda s: F.coalesce(f"{s}_kind", F.lit("blank")) == "blank"
    gone = blank("old") != blank("new")
    changed = ~old.eqNullSafe(new)
    columns = cells.filter(F.col("operator") == REENCODING).groupBy(*g.keys, "col").agg(F.count_if(~blank("old")).alias("total"), F.count_if(changed).alias("altered"))
    weak = columns.groupBy(*g.keys).agg(F.max(F.when(F.col("total") > 0, F.col("altered") / F.col("total"))).alias("share"))
    recoded = cells.filter(F.col("operator") == REENCODING).groupBy(*g.keys).agg(F.count("*").alias("n"), F.count_if(gone).alias("gone"), F.count_if(~gone & ~blank("old") & ~F.coalesce(values_equivalent(old, new), F.lit(False))).alias("other"))
    recoded = g.same.filter(F.col("operator") == REENCODING).select(*g.keys).join(recoded, g.keys, "left").fillna(0)
    number = (F.col("old_kind") == "number") & (F.col("new_kind") == "number")
    number, label = F.coalesce(number, F.lit(False)), F.coalesce((F.col("row") <= LABEL_ROWS) & (F.col("old_kind") == "text") & (F.col("new_kind") == "text"), F.lit(False))
    was, now = parse_plain_number(old), parse_plain_number(new)
    ratio = F.when(number & (was != 0), now / was)
    scaled = cells.filter(F.col("operator") == UNIT).groupBy(*g.keys).agg(F.count_if(number).alias("numbers"), F.count_if(~number & label).alias("labels"), F.count_if(~number & ~label).alias("others"), F.min(ratio).alias("lo"), F.max(ratio).alias("hi"))
    scaled = g.same.filter(F.col("operator") == UNIT).select(*g.keys).join(scaled, g.keys, "left").fillna(0, ["numbers", "labels", "others"])
    apart = ~F.coalesce(is_close(F.col("lo"), F.col("hi"), 1e-9, 1e-12), F.lit(True))
    return _union([
        _long(weak, {"reencoded_share": F.round("share", 6)}), _long(recoded, {"cells_changed": F.col("n"), "missingness_changed": F.col("gone"), "values_inequivalent": F.col("other"), "permitted_changes": F.col("n")}),
        _long(scaled, {"cells_without_unit": F.col("others"), "unit_parts_missing": ((F.col("numbers") == 0) | (F.col("labels") == 0)).cast("int"), "factors_apart": apart.cast("int"), "permitted_changes": F.col("numbers")}),
    ])


def _column_kinds(g: _Grids, cells: DataFrame, name: str) -> DataFrame:
    return cells.withColumn("kind", _kind()).filter("kind <> 'blank'").groupBy(*g.keys, "col").agg(F.collect_set("kind").alias(name))  # six at most


def _decoy_facts(g: _Grids, packages: DataFrame, packs: DataFrame, features: DataFrame) -> DataFrame:
    mine = packages.filter(F.col("operator") == DECOY).select("package", "operator")
    many = features.groupBy("package").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.count_if(~has_text(F.col("name"))).alias("unnamed"), F.count_if(~(has_text(F.col("name")) & has_text(F.col("source_field")) & has_text(F.col("noise_subtype")) & has_text(F.col("exclusion_reason")))).alias("bare"))
    whole = mine.join(packs, "package", "left").join(many, "package", "left").fillna(0, ["n", "names", "unnamed", "bare"])
    there = F.col("file").isNotNull()
    targets = F.coalesce((F.size("target_fields") > 0) & ~F.exists("target_fields", lambda t: ~has_text(t)), F.lit(False))
    lacking = (~has_text(F.col("misuse_answer"))).cast("int") + F.col("header_row").isNull().cast("int") + (~targets).cast("int") + (~F.col("n").between(2, 5)).cast("int")
    contract = whole.select("package", "operator", (~there).cast("int").alias("missing"), F.when(there, lacking).alias("lacking"), F.when(there, ((F.col("names") < F.col("n")) | (F.col("unnamed") > 0)).cast("int")).alias("names"), "bare")
    place = packs.select(*K, "header_row").join(many.select("package", "n"), "package")
    sheets = g.both.filter(F.col("operator") == DECOY).join(place, K, "left")
    cells = g.of(DECOY).join(sheets, g.keys)
    outside = cells.filter("n IS NULL").groupBy(*g.keys).agg(F.count_if("differs").alias("n"))
    head_wrong, shape_wrong = F.col("header_row") != 1, (F.col("rows_before") != F.col("rows_after")) | (F.col("cols_after") != F.col("cols_before") + F.col("n"))
    declared = sheets.filter("n IS NOT NULL")
    fine = declared.filter(~head_wrong & ~shape_wrong)
    kept = cells.join(fine.select(*g.keys), g.keys, "left_semi").filter("row <= rows_before AND col <= cols_before").groupBy(*g.keys).agg(F.count_if("differs").alias("n"))
    wanted = fine.select(*g.keys, "cols_before", "rows_before").join(features.select("package", "ordinal", "name", "source_field"), "package").withColumn("col", F.col("ordinal") + F.col("cols_before"))
    heads = g.side("after", DECOY).filter("row = 1").select(*g.keys, "col", F.col("value").alias("stands"))
    named = wanted.join(heads, [*g.keys, "col"], "left")
    off = named.groupBy(*g.keys).agg(F.count_if(~F.col("name").eqNullSafe(F.col("stands"))).alias("n"))
    sources = g.heads.filter("side = 'before'").groupBy(*g.keys, F.col("name").alias("source_field")).agg(F.min("col").alias("source_col"))
    sourced = wanted.join(sources, [*g.keys, "source_field"], "left")
    was = _column_kinds(g, g.side("before", DECOY).filter("row > 1"), "was").withColumnRenamed("col", "source_col")
    body = g.side("after", DECOY).filter("row > 1")
    filled = body.groupBy(*g.keys, "col").agg(F.count_if(_kind() != "blank").alias("filled"))
    judged = sourced.filter("source_col IS NOT NULL").join(was, [*g.keys, "source_col"], "left").join(_column_kinds(g, body, "is"), [*g.keys, "col"], "left").join(filled, [*g.keys, "col"], "left")
    sparse = (F.coalesce("filled", F.lit(0)) < DECOY_FILLED * F.greatest(F.lit(1), F.col("rows_before") - 1)) | F.col("is").isNull()
    other = F.col("was").isNotNull() & F.col("is").isNotNull() & (F.size(F.array_except("is", "was")) > 0)
    values = judged.groupBy(*g.keys).agg(F.count_if(sparse).alias("sparse"), F.count_if(other).alias("other"))
    return _union([
        _long(contract, {"pack_missing": F.col("missing"), "contract_texts_missing": F.col("lacking"), "feature_names_invalid": F.col("names"), "features_incomplete": F.col("bare")}, ["package", "operator"]),
        _long(outside, {"undeclared_cells_changed": F.col("n")}), _long(declared, {"header_row_invalid": head_wrong.cast("int"), "shape_invalid": F.when(~head_wrong, shape_wrong.cast("int"))}), _long(kept, {"original_cells_changed": F.col("n")}),
        _long(off, {"features_unmatched": F.col("n")}), _long(sourced.groupBy(*g.keys).agg(F.count_if(F.expr("source_col IS NULL")).alias("n")), {"sources_missing": F.col("n")}), _long(values, {"features_sparse": F.col("sparse"), "features_incompatible": F.col("other")}),
        _long(fine, {"permitted_changes": F.col("n")}),
    ])


def _non_observation_facts(g: _Grids, packages: DataFrame, rows: DataFrame, markers: DataFrame) -> DataFrame:
    mine = packages.filter(F.col("operator") == NON_OBSERVATION).select("package", "operator")
    texts = [has_text(F.col(c)) for c in ("file", "marker_field", "marker_value", "noise_subtype", "exclusion_reason", "misuse_answer")]
    whole = reduce(lambda a, b: a & b, texts) & F.coalesce(F.col("row_start") <= F.col("row_end"), F.lit(False)) & F.coalesce(F.col("noise_subtype").isin(*SUBTYPES), F.lit(False))
    counted = rows.groupBy("package").agg(F.count("*").alias("n"), F.count_if(~whole).alias("bare"))
    contract = mine.join(counted, "package", "left").select("package", "operator", F.col("n").isNull().cast("int").alias("missing"), "bare")
    marker = markers.select("package", F.col("name").alias("marker"), "observation_value")
    stated = rows.select(*K).distinct().withColumn("stated", F.lit(True))
    sheets = g.both.filter(F.col("operator") == NON_OBSERVATION).join(stated, K, "left").join(marker, "package", "left")
    cells = g.of(NON_OBSERVATION).join(sheets.drop("marker", "observation_value"), g.keys)
    outside = cells.filter("stated IS NULL").groupBy(*g.keys).agg(F.count_if("differs").alias("n"))
    declared = sheets.filter("stated")
    shape_wrong = (F.col("cols_after") != F.col("cols_before") + F.col("marker").isNotNull().cast("int")) | (F.col("rows_after") <= F.col("rows_before"))
    fine = declared.filter(~shape_wrong)
    mine_cells = cells.join(fine.select(*g.keys), g.keys, "left_semi")
    kept = mine_cells.filter("row <= rows_before AND col <= cols_before").groupBy(*g.keys).agg(F.count_if("differs").alias("n"))
    after = g.side("after", NON_OBSERVATION).join(fine, g.keys)
    last = after.filter("marker IS NOT NULL AND col = cols_after").groupBy(*g.keys).agg(F.count_if((F.col("row") == 1) & ~F.col("value").eqNullSafe(F.col("marker"))).alias("head"), F.count_if((F.col("row") > 1) & (F.col("row") <= F.col("rows_before")) & F.col("value").eqNullSafe(F.col("observation_value"))).alias("marked"), F.max(F.col("rows_before") - 1).alias("n"))
    ranges = rows.join(fine.select(*g.keys), K).select(*g.keys, F.col("row_start").cast("long").alias("start"), F.col("row_end").cast("long").alias("end"), "marker_field", "marker_value")
    wanted = fine.select(*g.keys, (F.col("rows_before") + 1).cast("long").alias("start"), F.col("rows_after").cast("long").alias("end"))
    covered = cover(ranges.select(*g.keys, "start", "end"), wanted, g.keys)
    heads = g.side("after", NON_OBSERVATION).filter("row = 1").groupBy(*g.keys, F.col("value").alias("marker_field")).agg(F.min("col").alias("marker_col"))
    placed = ranges.join(heads, [*g.keys, "marker_field"], "left")
    homeless = placed.groupBy(*g.keys).agg(F.count_if(F.expr("marker_col IS NULL")).alias("n"))
    # each appended row looks back to the last range that begins at it or before; only such a range can hold it, as ranges that overlap are an issue of their own
    spans = placed.filter("marker_col IS NOT NULL").select(*g.keys, F.col("marker_col").alias("col"), F.col("start").alias("row"), F.lit(0).alias("what"), F.struct("end", "marker_value").alias("span"), F.lit(None).cast("string").alias("value"))
    appended = after.filter("row > rows_before").select(*g.keys, "col", F.col("row").cast("long").alias("row"), F.lit(1).alias("what"), F.lit(None).cast("struct<end: bigint, marker_value: string>").alias("span"), "value")
    back = Window.partitionBy(*g.keys, "col").orderBy("row", "what").rowsBetween(Window.unboundedPreceding, 0)
    looked = spans.unionByName(appended).withColumn("held", F.last("span", ignorenulls=True).over(back)).filter("what = 1 AND row <= held.end")
    mismarked = looked.groupBy(*g.keys).agg(F.count_if(~F.col("value").eqNullSafe(F.col("held.marker_value"))).alias("n"))
    was = _column_kinds(g, g.side("before", NON_OBSERVATION).filter("row > 1"), "was")
    now = _column_kinds(g, after.filter("row > rows_before AND col <= cols_before"), "is")
    other = now.join(was, [*g.keys, "col"]).groupBy(*g.keys).agg(F.count_if(F.size(F.array_except("is", "was")) > 0).alias("n"))
    most = F.greatest(F.lit(5), F.ceil(F.greatest(F.lit(1), F.col("rows_before") - 1) * 0.1))
    return _union([
        _long(contract, {"declarations_missing": F.col("missing"), "declarations_incomplete": F.col("bare")}, ["package", "operator"]), _long(outside, {"undeclared_cells_changed": F.col("n")}), _long(declared, {"shape_invalid": shape_wrong.cast("int")}),
        _long(kept, {"original_cells_changed": F.col("n")}), _long(last, {"marker_header_invalid": F.col("head"), "observations_unmarked": F.col("n") - F.col("marked")}), _long(covered, {"rows_misdeclared": F.col("never") + F.col("again") + F.col("outside")}),
        _long(homeless, {"marker_fields_missing": F.col("n")}), _long(mismarked, {"rows_mismarked": F.col("n")}), _long(other, {"columns_incompatible": F.col("n")}),
        _long(fine, {"count_invalid": (F.col("rows_after") - F.col("rows_before") > most).cast("int"), "permitted_changes": F.col("rows_after") - F.col("rows_before")}),
    ])


def _cross_sheet_facts(g: _Grids) -> DataFrame:
    """Records of a file over all its sheets as one multiset: a record is its (header, cell) pairs in any order, whatever sheet it stands in."""
    mine = F.col("operator") == CROSS_SHEET
    cells = g.cells.filter(mine)
    per_file = ["operator", "package", "file"]
    heads = cells.filter("row = 1").select(*g.keys, "side", "col", F.coalesce("value", F.lit("")).alias("name"))
    unique = heads.groupBy(*g.keys, "side").agg((F.count("*") == F.count_distinct("name")).alias("unique"))
    named = cells.filter("row > 1").join(heads, [*g.keys, "side", "col"], "left").join(unique.filter("unique").select(*g.keys, "side"), [*g.keys, "side"])
    rows = _row_hashes(named.withColumn("name", F.coalesce("name", F.lit(""))), [*g.keys, "side", "row"], "name")
    sheets = cells.groupBy(*g.keys, "side").agg(F.max("row").alias("rows")).join(unique, [*g.keys, "side"], "left")
    invalid = (F.col("rows") < 2) | ~F.coalesce("unique", F.lit(False))
    kept = sheets.groupBy(*per_file).agg(F.count_if(F.expr("side = 'before'")).alias("a"), F.count_if(F.expr("side = 'after'")).alias("b"), F.count_if((F.col("side") == "after") & invalid).alias("invalid"))
    names = sheets.groupBy(*per_file, "sheet").agg(F.count_distinct("side").alias("sides")).groupBy(*per_file).agg(F.count_if(F.expr("sides = 1")).alias("moved"))
    formulas = _unmatched(cells.filter("formula IS NOT NULL"), per_file, ["formula", "style"])
    styles = cells.filter("row = 1 AND value IS NOT NULL").groupBy(*per_file, "value").agg(F.collect_set(F.when(F.col("side") == "before", F.coalesce("style", F.lit("")))).alias("was"), F.collect_set(F.when(F.col("side") == "after", F.coalesce("style", F.lit("")))).alias("is"))
    restyled = styles.groupBy(*per_file).agg(F.count_if((F.size("was") > 0) & (F.size(F.array_except("is", "was")) > 0)).alias("n"))
    return _union([
        _long(_unmatched(rows, per_file, ["h1", "h2"]), {"records_unmatched": F.col("unmatched")}, per_file), _long(kept, {"sheet_count_kept": (F.col("a") == F.col("b")).cast("int"), "sheets_invalid": F.col("invalid")}, per_file),
        _long(names, {"permitted_changes": F.col("moved")}, per_file), _long(formulas, {"formulas_unmatched": F.col("unmatched")}, per_file), _long(restyled, {"header_styles_new": F.col("n")}, per_file),
    ])


def _other_facts(g: _Grids) -> DataFrame:
    """Operators without a check of their own: whether anything changed."""
    known = (ROW_SHUFFLE, COLUMN_SHUFFLE, SYNONYM, DISTRACTOR, REENCODING, UNIT, DECOY, NON_OBSERVATION, CROSS_SHEET, DECOMPOSITION)
    return _long(g.placed.filter(~F.col("operator").isin(*known)).groupBy(*g.keys).agg(F.count_if("differs").alias("n")), {"permitted_changes": F.col("n")})


def package_facts(cells: DataFrame, packages: DataFrame, contracts: Contracts | None = None) -> DataFrame:
    """package, operator, file, sheet, fact, value of all packages (package, operator); file and sheet are null where a fact is about more than one."""
    spark = cells.sparkSession
    c = {name: (contracts or Contracts()).table(spark, name) for name in Contracts().schemas}
    g = _Grids(cells, packages)
    checks = {
        (ROW_SHUFFLE,): lambda: _row_shuffle_facts(g), (COLUMN_SHUFFLE, DISTRACTOR, DECOY): lambda: _heading_facts(g), (SYNONYM,): lambda: _synonym_facts(g, packages, c), (DISTRACTOR,): lambda: _distractor_facts(g, packages, c["distractors"]),
        (REENCODING, UNIT): lambda: _value_facts(g), (DECOY,): lambda: _decoy_facts(g, packages, c["packs"], c["features"]), (NON_OBSERVATION,): lambda: _non_observation_facts(g, packages, c["rows"], c["markers"]), (CROSS_SHEET,): lambda: _cross_sheet_facts(g),
    }
    known = {o for operators in checks for o in operators}
    there = {r["operator"] for r in packages.filter(F.col("operator").isin(*known)).select("operator").distinct().collect()}  # nine at most
    found = [written(f(), "facts") for operators, f in checks.items() if there & set(operators)]
    found = _union([*found, written(_union([_package_facts(g), _other_facts(g)]), "facts")])
    changes = found.filter("fact = 'permitted_changes'").groupBy("package", "operator").agg(F.sum("value").alias("value"))
    whole = packages.filter(F.col("operator") != DECOMPOSITION).select("package", "operator").join(changes, ["package", "operator"], "left").fillna(0.0)
    return found.filter("fact <> 'permitted_changes'").unionByName(_long(whole, {"permitted_changes": F.col("value")}, ["package", "operator"]))


def package_issues(cells: DataFrame, packages: DataFrame, contracts: Contracts | None = None) -> DataFrame:
    """package, operator, file, sheet, code, value: one row a broken rule, with the fact that breaks it. A package whose files differ has this issue only."""
    facts = package_facts(cells, packages, contracts)
    rules = F.broadcast(cells.sparkSession.createDataFrame([(o, code, fact, test, float(x)) for o, code, fact, test, x in RULES], "rule_operator string, code string, fact string, test string, limit double"))
    applies = F.col("rule_operator").isin("*") | (F.col("rule_operator") == F.col("operator"))
    broken = F.when(F.col("test") == ">", F.col("value") > F.col("limit")).when(F.col("test") == "<", F.col("value") < F.col("limit")).otherwise(F.col("value") == F.col("limit"))
    issues = written(facts.join(rules, "fact").filter(applies & broken).select("package", "operator", "file", "sheet", "code", "value"), "issues")
    lost = issues.filter("code = 'file_package_changed'")
    return issues.join(lost.select("package"), "package", "left_anti").unionByName(lost)
