"""Identifiers and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parse import has_text


def clean_id(x: Column) -> Column:
    """Integers become DA_n, text stays as it is, digits too; an empty id raises. For a variant column the type of each value decides."""
    kind = F.upper(F.typeof(x))
    if_variant = F.when(kind == "VARIANT", F.schema_of_variant(F.to_variant_object(F.struct(x.alias("v")))))  # OBJECT<v: BIGINT>
    whole = F.coalesce(if_variant.contains("BIGINT"), kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT"))
    t = x.cast("string")
    return F.when(whole & t.isNotNull(), F.concat(F.lit("DA_"), t)).when(F.coalesce(t != "", F.lit(False)), t).otherwise(F.raise_error(F.lit("a clean judgment has no id")))


def or_default(x: Column, default: str = "unknown") -> Column:
    return F.when(has_text(x), F.trim(x)).otherwise(F.lit(default))


def safe_name(x: Column) -> Column:
    """Characters that no file name may hold become one underscore."""
    return F.regexp_replace(F.trim(x), r'[\\/:*?"<>|]+', "_")


def model_name(file: Column, known: dict[str, str] | None = None, suffix: str = "_judgments.jsonl") -> Column:
    """A display name by table, else the file's name without its folder and suffix."""
    stem = F.regexp_replace(F.regexp_extract(file, r"([^/\\]+)$", 1), f"{suffix.replace('.', '[.]')}$", "")
    pairs = [F.lit(x) for kv in (known or {}).items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), stem), stem) if pairs else stem


def judgment_key(path: Column, row_id: Column, line: Column) -> Column:
    return F.concat_ws("::", path, row_id, line.cast("string"))


def natural_order(x: Column) -> list[Column]:
    """Sort columns for ids with a number at the end: the prefix, then the number."""
    return [F.regexp_extract(x, r"^(.*?)\d*$", 1), F.regexp_extract(x, r"(\d*)$", 1).try_cast("long")]
