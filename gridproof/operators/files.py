"""File references, packages and public records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields of a record's construction that are not published.
PRIVATE_FIELDS = ("construct_history", "validate_history", "judge_history", "construct_attempts", "validation_attempts")


def resolve_files(references: DataFrame, inventory: DataFrame) -> DataFrame:
    """sample, reference, path, found: the first candidate that exists: the reference itself, below the sample's folder, below the root.

    references has sample and reference, inventory has path. Where none exists the first candidate is kept. One join serves all candidates.
    """
    options = F.array(F.col("reference"), F.concat_ws("/", "sample", "reference"), F.concat(F.lit("./"), F.col("reference")))
    flat = references.select("sample", "reference", F.posexplode(options).alias("rank", "candidate"))
    known = inventory.select(F.col("path").alias("candidate"), F.lit(True).alias("exists")).distinct()
    best = F.min_by(F.struct("candidate", F.coalesce("exists", F.lit(False)).alias("found")), F.struct(F.col("exists").isNull(), F.col("rank")))
    return flat.join(known, "candidate", "left").groupBy("sample", "reference").agg(best.alias("b")).select("sample", "reference", F.col("b.candidate").alias("path"), "b.found")


def eligible_operators(packages: DataFrame, operators: DataFrame) -> DataFrame:
    """sample, operator, eligible, reason. packages: sample, suffixes, file_count; operators (a small catalog): operator, suffixes, least_files."""
    cat = F.broadcast(operators.select("operator", F.col("suffixes").alias("takes"), "least_files"))  # one row an operator
    rows = packages.crossJoin(cat)
    reason = F.when(~F.arrays_overlap("suffixes", "takes"), "unsupported_format").when(F.col("file_count") < F.col("least_files"), "too_few_files")
    return rows.select("sample", "operator", reason.isNull().alias("eligible"), reason.alias("reason"))


def public_records(records: DataFrame) -> DataFrame:
    """Records whose construction (a struct) is without histories and attempt counts; a record without one gets an empty one where the schema has it."""
    kind = records.schema["construction"].dataType
    private = [f for f in kind.fieldNames() if f in PRIVATE_FIELDS]
    whole = F.coalesce("construction", F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind]))
    return records.withColumn("construction", whole.dropFields(*private) if private else whole)


def workspace_manifest(packages: DataFrame) -> DataFrame:
    """sample, manifest: one JSON object a sample with its files in the order of their names. packages: sample, file, size, sha256."""
    entry = F.struct("file", "size", "sha256")
    rows = packages.groupBy("sample").agg(F.array_sort(F.collect_list(entry)).alias("files"))  # the files of one sample
    return rows.select("sample", F.to_json(F.struct("sample", "files")).alias("manifest"))


def missing_tables(questions: DataFrame, inventory: DataFrame) -> DataFrame:
    """Questions whose table file is not there, with the reason."""
    return questions.join(inventory.select(F.col("file").alias("file_name")), "file_name", "left_anti").withColumn("reason", F.lit("table_not_found"))


def require_fields(rows: DataFrame, fields: list[str], row: str = "row") -> DataFrame:
    """Rows of variant objects that all have the fields; a missing one raises and is named."""
    lacking = F.array_compact(F.array(*[F.when(F.try_variant_get(F.col(row), f"$.{f}", "variant").isNull(), F.lit(f)) for f in fields]))
    said = F.concat(F.lit("missing fields: "), F.array_join(lacking, ", "))
    return rows.withColumn(row, F.when(F.size(lacking) == 0, F.col(row)).otherwise(F.raise_error(said).cast("variant")))


def computed_aggregates(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n (values that are not blank), total, mean, least, most over the numbers in a text column; null without numbers.

    Numbers that ten decimals hold are added as decimals, so total and mean are exact in any order of rows; a group with any other number (or a sum of over 28 digits before the point) is added as doubles.
    """
    from ..functions.parse import has_text, parse_number

    x = parse_number(F.col(value))
    ten = x.try_cast("decimal(28, 10)")
    exact = F.when(ten.cast("double") == x, ten)
    rows = values.select(*by, value, x.alias("_x"), exact.alias("_exact"))
    total = F.coalesce(F.when(F.count("_exact") == F.count("_x"), F.try_sum("_exact").cast("double")), F.sum("_x"))
    return rows.groupBy(*by).agg(F.count_if(has_text(F.col(value))).alias("n"), total.alias("total"), F.try_divide(total, F.count("_x")).alias("mean"), F.min("_x").alias("least"), F.max("_x").alias("most"))
