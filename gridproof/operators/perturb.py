"""Seeded constructors of table perturbations.

Answer-preserving ones change the form of a table and none of its facts; answer-destroying ones take away or contradict
the evidence for an answer. All are functions of seed and key alone, so a task that runs again makes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import fmt
from ..sources.grid import number_rows

BROADCAST_GROUPS = 1_000_000


def draw(seed: str, *keys: Column) -> Column:
    """An md5 of seed and keys, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]))


def row_order_shuffle(df: DataFrame, keys: list[str], seed: str = "rows") -> DataFrame:
    """df with row_no (from 1) in an order that seed and keys give; numbered by ranges, so no task sorts all rows."""
    shuffled = df.withColumn("_order", draw(seed, *[F.col(k) for k in keys]))
    return number_rows(shuffled, ["_order", *keys]).drop("_order")


def column_order_shuffle(df: DataFrame, seed: str = "columns") -> list[str]:
    """All columns in an order that the seed gives, turned so that none keeps its place where it can be helped."""
    import hashlib

    order = sorted(df.columns, key=lambda c: hashlib.md5(f"{seed}|{c}".encode()).hexdigest())
    for turn in range(len(order)):
        turned = order[turn:] + order[:turn]
        if all(a != b for a, b in zip(turned, df.columns)):
            return turned
    return order


def header_synonyms(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """One to three columns under other names."""
    if not 1 <= len(names) <= 3 or set(names) - set(df.columns) or set(names.values()) & set(df.columns):
        raise ValueError("one to three existing columns take new names")
    return df.withColumnsRenamed(names)


def distractor_column(df: DataFrame, target: str, name: str, value: Column) -> DataFrame:
    """One more column, right after its target."""
    at = df.columns.index(target) + 1
    return df.withColumn(name, value).select(*df.columns[:at], name, *df.columns[at:])


def reencode(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns as equivalent text: thousands (separators), percent, date (year/month/day) or truth (yes and no); nulls stay."""
    forms = {
        "thousands": lambda c: fmt(c, "#,##0.00"),
        "percent": lambda c: F.concat(fmt(c * 100, "0.00"), F.lit("%")),
        "date": lambda c: F.date_format(c, "yyyy/MM/dd"),
        "truth": lambda c: F.when(c, "yes").when(~c, "no"),
    }
    return df.withColumns({c: forms[kind](F.col(c)) for c, kind in columns.items()})


def unit_scale(df: DataFrame, column: str, factor: float, name: str) -> DataFrame:
    """A column in another unit, with the unit in its name."""
    return df.withColumn(column, F.col(column) * F.lit(factor)).withColumnRenamed(column, name)


def decoy_features(df: DataFrame, key: str, value: str, group: str) -> DataFrame:
    """Three columns at the right that look like facts: a forecast, a rounded value and whether it is over its group's mean. All rows stay; null is a group too."""
    mean = df.groupBy(F.col(group).alias("_group")).agg(F.avg(value).alias("_mean"))
    mean = F.broadcast(mean) if mean.count() <= BROADCAST_GROUPS else mean  # the rows of a large group stay where they are
    out = df.join(mean, F.col(group).eqNullSafe(F.col("_group")), "left")
    return out.select(*df.columns, (F.floor(F.col(value) * 110 + 0.5) / 100).alias(f"{value}_forecast"), F.floor(F.col(value) / 1000).cast("long").alias(f"{value}_band"), (F.col(value) > F.col("_mean")).alias(f"{value}_above_mean"))


def non_observation_rows(df: DataFrame, key: str, n: int, marker: str = "record_type") -> DataFrame:
    """df and n simulated rows after it, told apart by a marker column; the rows with the n smallest keys, with keys beyond the largest."""
    top = df.agg(F.max(key).alias("_top"))
    first = df.orderBy(key).limit(n).crossJoin(F.broadcast(top))  # one row
    simulated = first.withColumn(key, F.col("_top") + 1 + F.row_number().over(Window.orderBy(key)).cast("long")).drop("_top")  # n rows
    return df.withColumn(marker, F.lit("observation")).unionByName(simulated.select(*df.columns, F.lit("simulated").alias(marker)))


def cross_sheet_split(df: DataFrame, by: str) -> DataFrame:
    """Rows with the sheet they go to: one sheet for each value of a field."""
    return df.withColumn("sheet", F.coalesce(F.col(by).cast("string"), F.lit("")))


def hierarchical_header(columns: list[str]) -> list[tuple[int, str, str]]:
    """(column, upper header, leaf header): names cut at their first underscore."""
    return [(i + 1, c.partition("_")[0], c.partition("_")[2] or c) for i, c in enumerate(columns)]


def relayout(grid: DataFrame, columns: list[str]) -> DataFrame:
    """A grid with its header in two rows; data rows move down by one."""
    heads = grid.sparkSession.createDataFrame([(r, i, "string", v) for i, up, leaf in hierarchical_header(columns) for r, v in ((1, up), (2, leaf))], "row int, col int, vtype string, value string")
    body = grid.filter("row > 1").select((F.col("row") + 1).alias("row"), "col", "vtype", "value")
    return heads.unionByName(body)


def field_missing(df: DataFrame, column: str) -> DataFrame:
    return df.drop(column)


def data_missing(df: DataFrame, column: str, needed: Column) -> DataFrame:
    """Needed values are null; nothing else changes."""
    return df.withColumn(column, F.when(~F.coalesce(needed, F.lit(False)), F.col(column)))


def evidence_conflict(df: DataFrame, column: str, facts: Column, other: Column) -> DataFrame:
    """A second row with another value for each of the chosen facts."""
    return df.unionByName(df.filter(facts).withColumn(column, other.cast(df.schema[column].dataType)))


def conflicting_header(grid: DataFrame, field: str, other: str) -> DataFrame:
    """A grid in whose first row one field carries the name of another; its values stay."""
    return grid.withColumn("value", F.when((F.col("row") == 1) & (F.col("value") == field), F.lit(other)).otherwise(F.col("value")))


def deep_analysis_missing(df: DataFrame, group: str, value: str, blocked: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three steps that need one another (filter, sum by group, rank) over data whose last step lacks its input: each step's result."""
    cut = data_missing(df, value, blocked)
    step1 = cut.filter(F.col(group).isNotNull())
    step2 = step1.groupBy(group).agg(F.count("*").alias("n"), F.count(value).alias("n_known"), F.sum(value).alias("total"))
    step3 = step2.filter("n_known = n").withColumn("rank", F.rank().over(Window.orderBy(F.desc("total"))))  # one row a group
    return step1, step2, step3


def structural_context_missing(grid: DataFrame) -> DataFrame:
    """A two-row header without its upper level: leaves repeat and no longer say what they measure."""
    return grid.filter("row > 1").select((F.col("row") - 1).alias("row"), "col", "vtype", "value")
