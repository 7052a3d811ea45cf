"""JSON-lines logs as DataFrames, with the place of each line."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .splits import number_lines, split_lines


def read_lines(spark: SparkSession, path: str | list[str], pattern: str | None = None, numbered: bool = False) -> DataFrame:
    """value, file, block, line_id: lines that are not blank; (file, block, line_id) sorts as the files do. numbered: line too, the number in the file from 1, blank ones counted.

    Folders are searched recursively; `pattern` is a glob for file names.
    """
    lines = split_lines(spark, path, pattern)
    return (number_lines(lines) if numbered else lines).filter(F.trim("value") != "")


def read_jsonl(spark: SparkSession, path: str | list[str], mode: str = "strict", pattern: str | None = None) -> DataFrame:
    """As read_lines with `row` (variant). strict: bad JSON or a value that is no object raises, with the line's number; lenient: any JSON; skip: bad lines go."""
    lines = read_lines(spark, path, pattern, numbered=mode == "strict").withColumn("row", F.try_parse_json("value"))
    if mode == "skip":
        return lines.filter(F.col("row").isNotNull())
    bad = F.col("row").isNull()
    if mode == "strict":
        bad = bad | ~F.schema_of_variant("row").startswith("OBJECT")
    elif mode != "lenient":
        raise ValueError(f"unknown mode {mode}")
    where = F.concat_ws(":", "file", *[c for c in ("line",) if c in lines.columns])
    said = F.concat(F.lit("bad JSON line in "), where, F.lit(": "), F.substring("value", 1, 80))
    return lines.withColumn("row", F.when(bad, F.raise_error(said).cast("variant")).otherwise(F.col("row")))


def field(name: str, kind: str = "string", row: str = "row"):
    """A field of the variant row, null where it is missing or of another type."""
    return F.try_variant_get(F.col(row), f"$.{name}", kind)


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, row: the elements of JSON files that hold a list, or the one object of each other file."""
    whole = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_name").alias("file"), F.parse_json("value").alias("doc"))
    listed = F.schema_of_variant("doc").startswith("ARRAY")
    items = F.when(listed, F.variant_get("doc", "$", "array<variant>")).otherwise(F.array("doc"))
    return whole.select("file", F.posexplode(items).alias("ordinal", "row"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """file (its path below the folder), size, sha256 of all files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    folder = F.regexp_replace(F.lit(path.rstrip("/")), r"^[a-z0-9+.-]+:/*", "/")
    below = F.substring(F.col("path"), F.instr("path", folder) + F.length(folder) + 1, F.length("path"))
    return found.select(below.alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def judgment_files(spark: SparkSession, paths: list[str], pattern: str = "*_judgments.jsonl") -> DataFrame:
    """file: the logs that files, folders (searched below) and globs name, once each; tables of judgments (*_tabular_judgments.jsonl) are none. Nothing found raises."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(paths).select(F.col("path").alias("file"))
    files = found.filter(~F.col("file").endswith("_tabular_judgments.jsonl")).distinct()
    if files.isEmpty():
        raise ValueError(f"no {pattern} in {', '.join(paths)}")
    return files


def append_jsonl(df: DataFrame, path: str) -> None:
    """One compact JSON object a line, nulls kept; the commit protocol makes an append whole or absent."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", "true").csv(path)


def preview_keys(rows: DataFrame, sample: int = 8) -> DataFrame:
    """file, key, first_row, rows: keys of the first rows of each file, with the first row that has each. rows has file, ordinal and row (variant objects)."""
    first = rows.filter(F.col("ordinal") < sample).select("file", "ordinal", F.variant_get("row", "$", "map<string, variant>").alias("fields"))
    flat = first.select("file", "ordinal", F.explode(F.map_keys("fields")).alias("key"))
    return flat.groupBy("file", "key").agg(F.min("ordinal").alias("first_row"), F.count("*").alias("rows"))


def _keys_in_order(texts: pd.Series) -> pd.Series:
    def keys(text: str) -> list[str]:
        value = json.loads(text)
        return list(value) if isinstance(value, dict) else []

    return texts.map(keys)


def preview_jsonl(spark: SparkSession, path: str | list[str], sample: int = 8, pattern: str | None = None) -> DataFrame:
    """file, rows, columns, sample: lines of each file that are not blank, the keys of its first `sample` lines in the order in which they are first seen, and these lines.

    Variants sort the keys of an object, so keys are read from the text. All lines are counted, only the first are parsed; a bad one of them raises.
    """
    lines = read_lines(spark, path, pattern, numbered=True)
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row a split
    early = splits.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < sample)  # the splits in which the first lines stand
    first = Window.partitionBy("file").orderBy("line")
    top = lines.join(early.select("file", "block"), ["file", "block"], "left_semi").withColumn("place", F.row_number().over(first)).filter(F.col("place") <= sample)
    heads = top.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("head"))
    head = splits.groupBy("file").agg(F.sum("n").alias("rows")).join(heads, "file")
    flat = head.select("file", F.posexplode("head").alias("at", "x")).select("file", "at", F.pandas_udf(_keys_in_order, "array<string>")("x.value").alias("keys"))
    seen = flat.select("file", "at", F.posexplode("keys").alias("place", "key")).groupBy("file", "key").agg(F.min(F.struct("at", "place")).alias("first"))
    columns = seen.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "key"))), lambda k: k["key"]).alias("columns"))
    return head.join(columns, "file", "left").select("file", "rows", F.coalesce("columns", F.array().cast("array<string>")).alias("columns"), F.transform("head", lambda x: x["value"]).alias("sample"))


def row_counts(spark: SparkSession, path: str) -> DataFrame:
    """file, rows: exact numbers of data rows of delimited files, by counting lines (a header line is none)."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.groupBy(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file")).agg((F.count("*") - 1).alias("rows"))
