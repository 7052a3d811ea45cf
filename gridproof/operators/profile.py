"""Profiles of tables in grid form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import family, has_text

HEADER_ROWS = 3
SAMPLE_ROWS = 8
MERGES_LISTED = 20


def header_scores(grid: DataFrame) -> DataFrame:
    """file, sheet, row, nonempty, strings, numbers, formulas, distinct_values, score of the first rows."""
    v = F.col("value")
    text = has_text(v)
    formula = text & v.startswith("=")
    number = text & (family(v) == "number")
    sums = grid.filter(F.col("row") <= HEADER_ROWS).groupBy("file", "sheet", "row").agg(
        F.count_if(text).alias("nonempty"), F.count_if(text & ~number & ~formula).alias("strings"), F.count_if(number).alias("numbers"), F.count_if(formula).alias("formulas"),
        F.count_distinct(F.when(text, F.lower(F.trim(v)))).alias("distinct_values"),
    )
    score = 4 * F.col("strings") + 1.5 * F.col("distinct_values") + F.col("nonempty") - 2 * F.col("numbers") - 3 * F.col("formulas") - F.when(F.col("nonempty") == 1, 8).otherwise(0)
    return sums.withColumn("score", F.when(F.col("nonempty") == 0, F.lit(-1000) + F.col("row") - 1).otherwise(score).cast("double"))


def header_row(grid: DataFrame) -> DataFrame:
    """file, sheet, header_row, score: the first row of the highest score."""
    best = F.max_by(F.struct("row", "score"), F.struct("score", -F.col("row")))
    return header_scores(grid).groupBy("file", "sheet").agg(best.alias("b")).select("file", "sheet", F.col("b.row").alias("header_row"), F.col("b.score").alias("score"))


def column_names(headers: DataFrame) -> DataFrame:
    """file, sheet, col, base, name, repeated from header cells: blanks become Unnamed: i, repeats name.k."""
    base = F.when(has_text(F.col("value")), F.trim("value")).otherwise(F.concat(F.lit("Unnamed: "), (F.col("col") - 1).cast("string")))
    k = F.row_number().over(Window.partitionBy("file", "sheet", "base").orderBy("col")) - 1
    rows = headers.withColumn("base", base).withColumn("k", k)
    return rows.select("file", "sheet", "col", "base", F.when(F.col("k") > 0, F.concat("base", F.lit("."), F.col("k").cast("string"))).otherwise(F.col("base")).alias("name"), (F.col("k") > 0).alias("repeated"))


def column_types(grid: DataFrame, header: int = 1) -> DataFrame:
    """file, sheet, col, dtype, nonempty of each column over the first rows below the header; mixed families are mixed."""
    rows = grid.filter((F.col("row") > header) & (F.col("row") <= header + SAMPLE_ROWS)).withColumn("f", family(F.col("value")))
    sets = rows.groupBy("file", "sheet", "col").agg(F.array_sort(F.collect_set(F.when(F.col("f") != "blank", F.col("f")))).alias("s"), F.count_if(F.col("f") != "blank").alias("nonempty"))
    dtype = F.when(F.size("s") == 0, "empty").when(F.size("s") == 1, F.element_at("s", 1)).otherwise("mixed")
    return sets.select("file", "sheet", "col", dtype.alias("dtype"), "nonempty")


def multirow_header(grid: DataFrame) -> DataFrame:
    """file, sheet, looks_multirow: the header isn't in the first row, or the first row has fewer cells than a later one."""
    scores = header_scores(grid)
    sums = scores.groupBy("file", "sheet").agg(F.max(F.when(F.col("row") == 1, F.col("nonempty"))).alias("first"), F.max(F.when(F.col("row") > 1, F.col("nonempty"))).alias("later"))
    both = sums.join(header_row(grid), ["file", "sheet"])
    return both.select("file", "sheet", ((F.col("header_row") > 1) | ((F.col("first") > 0) & (F.col("first") < F.coalesce("later", F.lit(0))))).alias("looks_multirow"))


def sheet_profile(grid: DataFrame) -> DataFrame:
    """file, sheet, rows, cols, cells, formulas, dimension_suspect."""
    sums = grid.groupBy("file", "sheet").agg(F.max("row").alias("rows"), F.max("col").alias("cols"), F.count_if(has_text(F.col("value"))).alias("cells"), F.count_if(F.coalesce(F.col("value").startswith("="), F.lit(False))).alias("formulas"))
    return sums.withColumn("dimension_suspect", (F.col("rows") >= 1_000_000) | (F.col("cols") >= 10_000))


def workbook_profile(sheets: DataFrame, grid: DataFrame) -> DataFrame:
    """file, sheets, merges, ranges (the first MERGES_LISTED), header_merges, formulas, complex_structure_candidate.

    A workbook may be complex if it has several sheets, a merged header, a header of several rows, or a header cell that repeats. sheets: rows of
    sources.grid.workbook_structure; grid: its cells.
    """
    order = F.row_number().over(Window.partitionBy("file").orderBy("sheet", "at"))
    listed = sheets.select("file", "sheet", F.posexplode("merges").alias("at", "ref")).withColumn("k", order).filter(F.col("k") <= MERGES_LISTED)
    ranges = listed.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("k", "ref"))).alias("r")).select("file", F.col("r")["ref"].alias("ranges"))
    several = multirow_header(grid).groupBy("file").agg(F.bool_or("looks_multirow").alias("multirow"))
    again = column_names(grid.filter("row = 1")).groupBy("file").agg(F.bool_or("repeated").alias("again"))
    sums = sheets.filter("error IS NULL").groupBy("file").agg(F.count("*").alias("sheets"), F.sum(F.size("merges")).alias("merges"), F.sum("header_merges").alias("header_merges"), F.sum("formulas").alias("formulas"))
    rows = sums.join(ranges, "file", "left").join(several, "file", "left").join(again, "file", "left")
    no = F.lit(False)
    complex_ = (F.col("sheets") > 1) | (F.col("header_merges") > 0) | F.coalesce("multirow", no) | F.coalesce("again", no)
    return rows.select("file", "sheets", "merges", F.coalesce("ranges", F.array().cast("array<string>")).alias("ranges"), "header_merges", "formulas", complex_.alias("complex_structure_candidate"))


def package_profile(files: DataFrame) -> DataFrame:
    """package, file_count, existing_file_count, all_files_exist, kinds from package, file, found."""
    suffix = F.lower(F.regexp_extract("file", r"(\.[^.]+)$", 1))
    kind = F.when(suffix.isin(".xlsx", ".xlsm", ".xltx", ".xltm"), "excel").when(suffix == ".xls", "legacy_excel").when(suffix.isin(".csv", ".tsv", ".txt"), "delimited").when(suffix.isin(".jsonl", ".ndjson"), "jsonl").when(suffix == ".json", "json").otherwise("unsupported")
    rows = files.withColumn("kind", kind).groupBy("package").agg(F.count("file").alias("file_count"), F.count_if("found").alias("existing_file_count"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return rows.withColumn("all_files_exist", (F.col("file_count") > 0) & (F.col("file_count") == F.col("existing_file_count")))


PREVIEW_COLS = 200


def sheet_report(grid: DataFrame) -> DataFrame:
    """One row a sheet with all that a profile says of it.

    file, sheet, max_row, max_column, n_rows (below the header), column_count, profiled_column_count, column_profile_truncated, header_row_number, raw_columns, columns (blanks named, repeats
    numbered), dtypes, sample_rows (the first SAMPLE_ROWS below the header), header_preview (the first HEADER_ROWS), unnamed_column_count, unnamed_columns, duplicate_like_columns, duplicate_base_names,
    possible_multirow_header, possible_duplicate_header, dimension_suspect. Lists go by column; at most PREVIEW_COLS columns and the first rows of a sheet are gathered.
    """
    keys = ["file", "sheet"]
    cut = grid.filter(F.col("col") <= PREVIEW_COLS)
    sizes = grid.groupBy(*keys).agg(F.max("row").alias("max_row"), F.max("col").alias("max_column")).join(header_row(cut).select(*keys, "header_row"), keys).join(multirow_header(cut), keys)
    wide = F.least(F.col("max_column"), F.lit(PREVIEW_COLS))
    first = F.greatest(F.lit(HEADER_ROWS), F.col("header_row") + SAMPLE_ROWS)
    places = sizes.select(*keys, "header_row", F.explode(F.sequence(F.lit(1), wide)).alias("col"))
    known = cut.join(sizes.select(*keys, "header_row", first.alias("last"), F.col("max_row")), keys).filter("row <= last").select(*keys, "row", "col", "value", "header_row")
    heads = places.join(known.filter("row = header_row").select(*keys, "col", "value"), [*keys, "col"], "left")
    kinds = known.filter("row > header_row").withColumn("f", family(F.col("value"))).groupBy(*keys, "col").agg(F.array_sort(F.collect_set(F.when(F.col("f") != "blank", F.col("f")))).alias("s"))
    dtype = F.when(F.coalesce(F.size("s"), F.lit(0)) <= 0, "empty").when(F.size("s") == 1, F.element_at("s", 1)).otherwise("mixed")
    named = column_names(heads).join(heads.select(*keys, "col", "value"), [*keys, "col"]).join(kinds, [*keys, "col"], "left").withColumn("dtype", dtype)
    listed = lambda c, when=None: F.transform(F.array_sort(F.collect_list(F.struct("col", F.col(c).alias("x")) if when is None else F.when(when, F.struct("col", F.col(c).alias("x"))))), lambda p: p["x"])
    unnamed = F.lower("name").startswith("unnamed:")
    columns = named.groupBy(*keys).agg(
        listed("value").alias("raw_columns"), listed("name").alias("columns"), listed("dtype").alias("dtypes"), F.count_if(unnamed).alias("unnamed_column_count"), listed("name", unnamed).alias("unnamed_columns"),
        listed("name", F.col("name").rlike(r"\.\d+$")).alias("duplicate_like_columns"), F.array_distinct(listed("base", F.col("repeated"))).alias("duplicate_base_names"),
    )
    rows = known.groupBy(*keys, "row", "header_row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("cells"))
    gathered = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("row", F.map_entries("cells").alias("cells"))))), lambda r: r["cells"])
    some = rows.groupBy(*keys).agg(gathered(F.col("row") > F.col("header_row")).alias("sampled"), gathered(F.col("row") <= HEADER_ROWS).alias("headed"))
    whole = sizes.join(columns, keys).join(some, keys)
    filled = lambda c: F.transform(c, lambda r: F.transform(F.sequence(F.lit(1), wide), lambda i: F.try_element_at(F.map_from_entries(r), i)))
    return whole.select(
        *keys, "max_row", "max_column", F.greatest(F.lit(0), F.col("max_row") - F.col("header_row")).alias("n_rows"), F.col("max_column").alias("column_count"), wide.alias("profiled_column_count"), (F.col("max_column") > wide).alias("column_profile_truncated"),
        F.col("header_row").alias("header_row_number"), "raw_columns", "columns", "dtypes", filled("sampled").alias("sample_rows"), filled("headed").alias("header_preview"), "unnamed_column_count", "unnamed_columns", "duplicate_like_columns", "duplicate_base_names",
        F.col("looks_multirow").alias("possible_multirow_header"), (F.size("duplicate_base_names") > 0).alias("possible_duplicate_header"), ((F.col("max_row") >= 1_000_000) | (F.col("max_column") >= 10_000)).alias("dimension_suspect"),
    )
