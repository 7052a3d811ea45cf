"""Manifests and small text reports; each takes a table that fits a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_ROWS = 10_000
#: Characters that LaTeX needs escaped.
TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}"}


def _page(df: DataFrame, order: list[str]) -> list:
    rows = df.orderBy(*order).take(PAGE_ROWS + 1)
    if len(rows) > PAGE_ROWS:
        raise ValueError(f"a report has at most {PAGE_ROWS} rows; write the table instead")
    return rows


def read_manifest(spark: SparkSession, path: str, required: list[str], unique: list[str] | None = None) -> DataFrame:
    """A CSV whose required columns are all there and filled, and unique by some of them."""
    df = spark.read.option("header", "true").csv(path)
    if lacking := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} has no column {', '.join(lacking)}")
    blank = F.lit(False)
    for c in required:
        blank = blank | (F.coalesce(F.trim(c), F.lit("")) == "")
    if not df.filter(blank).isEmpty():
        raise ValueError(f"{path} has blank fields")
    if unique and not df.groupBy(*unique).count().filter("count > 1").isEmpty():
        raise ValueError(f"{path} repeats {', '.join(unique)}")
    return df


def markdown(df: DataFrame, section: str, order: list[str]) -> str:
    """One section and table for each value of a column."""
    columns = [c for c in df.columns if c != section]
    out, last = [], object()
    for r in _page(df, [section, *order]):
        if r[section] != last:
            last = r[section]
            out += ["", f"## {last}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
        out.append("| " + " | ".join("" if r[c] is None else str(r[c]).replace("|", "\\|") for c in columns) + " |")
    return "\n".join(out[1:]) + "\n"


def latex(df: DataFrame, first: str, order: list[str]) -> str:
    """A tabular body; the first column is named once a group, and groups are parted by rules."""
    escape = lambda x: "" if x is None else "".join(TEX.get(c, c) for c in str(x))
    columns = [c for c in df.columns if c != first]
    out, last = [f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}", "\\toprule", " & ".join(map(escape, [first, *columns])) + r" \\", "\\midrule"], None
    for i, r in enumerate(_page(df, [first, *order])):
        if i and r[first] != last:
            out.append("\\midrule")
        out.append(" & ".join([escape(r[first]) if not i or r[first] != last else "", *[escape(r[c]) for c in columns]]) + r" \\")
        last = r[first]
    return "\n".join([*out, "\\bottomrule", "\\end{tabular}", ""])


def json_report(df: DataFrame, by: list[str]) -> DataFrame:
    """One JSON object with the rows of a report in order; over PAGE_ROWS rows raise."""
    df = df.limit(PAGE_ROWS + 1)
    row = F.struct(*df.columns)
    said = F.to_json(F.struct(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.struct(*by, row.alias("row")))).alias("items")))
    return df.agg(F.when(F.count("*") <= PAGE_ROWS, said).otherwise(F.raise_error(F.lit(f"a report has at most {PAGE_ROWS} rows")).cast("string")).alias("report"))
