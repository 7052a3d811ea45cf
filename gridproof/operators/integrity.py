"""Proofs that a perturbation changed what it promised and nothing else."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import family, values_equivalent
from ..functions.rounding import rate
from .shape import multiset_difference

#: Least shares that each check asks for.
ROWS_MOVED, COLUMNS_MOVED, DISTRACTOR_COVERAGE, DISTRACTOR_DIFFERENT, REENCODED, DECOY_COVERAGE = 0.8, 0.6, 0.5, 0.3, 0.3, 0.6


def row_shuffle_check(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """rows, moved, moved_share, multiset_issues, passed. Both have row_no; rows that equal the one formerly there count as unmoved."""
    a = before.select("row_no", F.struct(*columns).alias("a"))
    b = after.select("row_no", F.struct(*columns).alias("b"))
    moved = a.join(b, "row_no", "full").agg(F.count("*").alias("rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("moved"))
    differ = multiset_difference(before.select(*columns), after.select(*columns)).agg(F.count("*").alias("multiset_issues"))
    out = moved.crossJoin(differ).withColumn("moved_share", rate(F.col("moved"), F.col("rows")))  # one row each
    return out.withColumn("passed", (F.col("multiset_issues") == 0) & (F.col("moved_share") >= ROWS_MOVED))


def column_shuffle_check(before: list[str], after: list[str]) -> dict:
    moved = sum(a != b for a, b in zip(before, after))
    unique = len(set(before)) == len(before)
    return {"columns": len(before), "moved": moved, "passed": unique and sorted(before) == sorted(after) and moved >= COLUMNS_MOVED * len(before)}


def originals_unchanged(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """changed: rows of the original columns that are not the same multiset before and after."""
    return multiset_difference(before.select(*columns), after.select(*columns)).agg(F.count("*").alias("changed"))


def distractor_check(after: DataFrame, target: str, added: str) -> DataFrame:
    """target_values, coverage, different, passed: enough of the added column is filled, has values of a kind that its target has, and differs from it."""
    a, b = F.col(added), F.col(target)
    kind = lambda c: F.collect_set(F.when(c.isNotNull(), family(c.cast("string"))))  # noqa: E731 (five at most)
    sums = after.agg(
        F.count(target).alias("target_values"), F.count_if(a.isNotNull() & b.isNotNull()).alias("both"), F.count_if(a.isNotNull() & b.isNotNull() & (a.cast("string") != b.cast("string"))).alias("apart"), F.count(added).alias("filled"),
        kind(a).alias("added_kinds"), kind(b).alias("target_kinds"),
    )
    kinds = F.arrays_overlap("added_kinds", "target_kinds") | (F.size("added_kinds") == 0) | (F.size("target_kinds") == 0)
    out = sums.select("target_values", rate(F.col("filled"), F.col("target_values")).alias("coverage"), rate(F.col("apart"), F.col("both")).alias("different"), kinds.alias("kinds"))
    return out.withColumn("passed", F.col("kinds") & (F.col("coverage") >= DISTRACTOR_COVERAGE) & (F.col("different") >= DISTRACTOR_DIFFERENT)).drop("kinds")


def _matched(before: DataFrame, after: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Pairs of the compared columns (before: after) as a{i} and b{i}, for each key of either side, with damaged: the row is lost or added, or another column differs."""
    rest = [c for c in before.columns if c != key and c not in columns]
    others = [c for c in after.columns if c != key and c not in columns.values()]
    if sorted(rest) != sorted(others):
        raise ValueError(f"columns {sorted(set(rest) ^ set(others))} are on one side only")
    side = lambda t, names, x: t.select(key, F.struct(F.lit(x).alias("there"), *rest).alias(f"r{x}"), *[F.col(c).alias(f"{x}{i}") for i, c in enumerate(names)])
    joined = side(before, columns, "a").join(side(after, columns.values(), "b"), key, "full")
    same = reduce(lambda x, y: x & y, [F.col(f"ra.{c}").eqNullSafe(F.col(f"rb.{c}")) for c in rest], F.col("ra.there").isNotNull() & F.col("rb.there").isNotNull())
    return joined.withColumn("damaged", ~same)


def reencoding_check(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """column, cells, changed, inequivalent, missing_changed, passed for each recoded column; none passes if rows are lost or added or another column changed."""
    joined = _matched(before, after, key, {c: c for c in columns})
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a{i}").cast("string").alias("a"), F.col(f"b{i}").cast("string").alias("b")) for i, c in enumerate(columns)])
    flat = joined.select("damaged", F.explode(pairs).alias("x")).select("damaged", "x.*")
    sums = flat.groupBy("column").agg(
        F.count("a").alias("cells"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if(~values_equivalent(F.col("a"), F.col("b"))).alias("inequivalent"),
        F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("missing_changed"), F.count_if("damaged").alias("damaged"),
    )
    passed = (F.col("damaged") == 0) & (F.col("inequivalent") == 0) & (F.col("missing_changed") == 0) & (F.col("changed") >= REENCODED * F.col("cells"))
    return sums.withColumn("passed", passed).drop("damaged")


def unit_check(before: DataFrame, after: DataFrame, key: str, column: str, renamed: str) -> DataFrame:
    """values, least_ratio, most_ratio, zero_changed, passed: one factor for all values that are not zero, a new name, no row lost or added, no value lost, no other column changed."""
    j = _matched(before, after, key, {column: renamed}).withColumnsRenamed({"a0": "a", "b0": "b"})
    ratio = F.when(F.col("a") != 0, F.col("b") / F.col("a"))
    gone = F.col("damaged") | (F.col("a").isNull() != F.col("b").isNull())
    sums = j.agg(F.count("a").alias("values"), F.min(ratio).alias("lo"), F.max(ratio).alias("hi"), F.count_if((F.col("a") == 0) & (F.col("b") != 0)).alias("zero_changed"), F.count_if(gone).alias("damaged"))
    same = F.abs(F.col("hi") - F.col("lo")) <= F.greatest(F.lit(1e-9) * F.abs(F.col("hi")), F.lit(1e-12))
    passed = same & (F.col("zero_changed") == 0) & (F.abs(F.col("hi") - 1) > 1e-9) & (F.col("damaged") == 0) & F.lit(column != renamed)
    return sums.select("values", F.round("lo", 6).alias("least_ratio"), F.round("hi", 6).alias("most_ratio"), "zero_changed", passed.alias("passed"))


def coverage_check(after: DataFrame, columns: list[str]) -> DataFrame:
    """column, filled, coverage, passed of each added column."""
    sums = after.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    flat = sums.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns])).alias("x"))
    return flat.select("x.column", "x.filled", rate(F.col("x.filled"), F.col("n")).alias("coverage")).withColumn("passed", F.col("coverage") >= DECOY_COVERAGE)


def non_observation_check(before: DataFrame, after: DataFrame, marker: str = "record_type") -> DataFrame:
    """observed, added, allowed, changed, passed: originals unchanged and marked, at most max(5, a tenth) rows added."""
    originals = multiset_difference(before, after.filter(F.col(marker) == "observation").drop(marker)).agg(F.count("*").alias("changed"))
    sums = after.agg(F.count_if(F.col(marker) == "observation").alias("observed"), F.count_if(~F.col(marker).eqNullSafe(F.lit("observation"))).alias("added"))
    out = sums.crossJoin(originals).withColumn("allowed", F.greatest(F.lit(5), F.ceil(F.col("observed") / 10)).cast("long"))  # one row each
    return out.withColumn("passed", (F.col("changed") == 0) & (F.col("added") >= 1) & (F.col("added") <= F.col("allowed")))


def package_diff(original: DataFrame, final: DataFrame) -> DataFrame:
    """file, state (added, removed, changed, unchanged) from inventories of file and sha256."""
    a, b = original.select("file", F.col("sha256").alias("a")), final.select("file", F.col("sha256").alias("b"))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return a.join(b, "file", "full").select("file", state.alias("state"))


def missing_values_check(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """nulled, filled, altered, others_changed, passed: values only vanish, and only in one column."""
    rest = [c for c in before.columns if c not in (key, column)]
    j = before.select(key, F.col(column).alias("a"), F.struct(*rest).alias("ra")).join(after.select(key, F.col(column).alias("b"), F.struct(*rest).alias("rb")), key, "full")
    sums = j.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("nulled"), F.count_if(F.col("a").isNull() & F.col("b").isNotNull()).alias("filled"),
        F.count_if(F.col("a") != F.col("b")).alias("altered"), F.count_if(~F.col("ra").eqNullSafe(F.col("rb"))).alias("others_changed"),
    )
    return sums.withColumn("passed", (F.col("nulled") > 0) & (F.col("filled") + F.col("altered") + F.col("others_changed") == 0))


def conflicts(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, n_values of facts with contradictory values."""
    return df.groupBy(key).agg(F.count_distinct(column).alias("n_values")).filter("n_values > 1")


def equivalent_fields(df: DataFrame, field: str, candidates: list[str]) -> DataFrame:
    """candidate, is_bijection: whether a candidate column determines the field one to one, so that dropping the field removes nothing."""
    sums = df.agg(F.count_distinct(field).alias("f"), *[F.count_distinct(c).alias(f"c_{c}") for c in candidates], *[F.count_distinct(field, c).alias(f"b_{c}") for c in candidates])
    rows = [F.struct(F.lit(c).alias("candidate"), ((F.col(f"b_{c}") == F.col("f")) & (F.col(f"b_{c}") == F.col(f"c_{c}"))).alias("is_bijection")) for c in candidates]
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """check, passed of several one-row checks."""
    return reduce(DataFrame.unionByName, [df.agg(F.bool_and("passed").alias("passed")).select(F.lit(name).alias("check"), "passed") for name, df in checks.items()])
