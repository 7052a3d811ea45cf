"""Attempt logs to one row an id: the last valid attempt wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_valid(attempts: DataFrame, keys: list[str], order: str, valid: Column, values: list[str]) -> DataFrame:
    """keys, values of the last valid attempt (else of the last), line (of that attempt), first_line, attempts, selected_valid.

    Partial aggregation keeps one candidate a key and task, so a key with very many attempts moves few rows.
    """
    row = F.struct(order, *values)
    best = F.coalesce(F.max_by(row, F.when(valid, F.col(order))), F.max_by(row, F.col(order)))
    out = attempts.groupBy(*keys).agg(
        best.alias("_best"), F.min(order).alias("first_line"), F.count("*").alias("attempts"), F.coalesce(F.bool_or(valid), F.lit(False)).alias("selected_valid")
    )
    return out.select(*keys, F.col(f"_best.{order}").alias("line"), *[F.col(f"_best.{v}").alias(v) for v in values], "first_line", "attempts", "selected_valid")


def judged(rows: DataFrame) -> Column:
    """The outcome of a judgment: none where judging failed (a missing status counts as done), else is_correct, else whether a finite score is 1.

    rows has judge_status and is_correct, and may have score.
    """
    score = F.col("score").cast("double") if "score" in rows.columns else F.lit(None).cast("double")
    by_score = F.when(~F.isnan(score) & (F.abs(score) != F.lit(float("inf"))), score == 1)
    return F.when(F.col("judge_status").isNull() | (F.col("judge_status") == "success"), F.coalesce(F.col("is_correct"), by_score))


def canonical_clean(attempts: DataFrame) -> DataFrame:
    """id, correct, line, attempts, all_failed from clean judgments (id, line, judge_status, is_correct and maybe score).

    Summary rows go. An id none of whose attempts was scored counts as wrong.
    """
    outcome = attempts.withColumn("is_correct", judged(attempts))
    rows = last_valid(outcome.filter("id <> '__summary__'"), ["id"], "line", F.col("is_correct").isNotNull(), ["is_correct"])
    return rows.select("id", (F.col("selected_valid") & F.col("is_correct")).alias("correct"), "line", "attempts", (~F.col("selected_valid")).alias("all_failed"))


def canonical_predictions(attempts: DataFrame) -> DataFrame:
    """id, line, status, answer, first_line, attempts, is_success: the last success with an answer, else the last attempt."""
    good = (F.col("status") == "success") & F.coalesce(F.trim("answer") != "", F.lit(False))
    out = last_valid(attempts, ["id"], "line", F.coalesce(good, F.lit(False)), ["status", "answer"])
    return out.withColumnRenamed("selected_valid", "is_success")


def canonicalization_stats(attempts: DataFrame) -> DataFrame:
    """physical, summary, unique_ids, collapsed, selected_successes, selected_failures."""
    sums = attempts.agg(F.count("*").alias("physical"), F.count_if(F.col("id") == "__summary__").alias("summary"))
    kept = canonical_clean(attempts).agg(F.count("*").alias("unique_ids"), F.count_if(~F.col("all_failed")).alias("selected_successes"), F.count_if("all_failed").alias("selected_failures"))
    both = sums.crossJoin(kept)  # one row each
    return both.select("physical", "summary", "unique_ids", (F.col("physical") - F.col("summary") - F.col("unique_ids")).alias("collapsed"), "selected_successes", "selected_failures")


def limit_ids(canonical: DataFrame, limit: int | None) -> DataFrame:
    """The first ids by the line on which they first came, after repeats are gone; without a limit, or with a negative one, all."""
    return canonical if limit is None or limit < 0 else canonical.orderBy("first_line", "id").limit(limit)


def single_model(rows: DataFrame) -> DataFrame:
    """model: the one name that rows have, trimmed; none or several raise."""
    sums = rows.agg(F.collect_set(F.nullif(F.trim("model"), F.lit(""))).alias("m"))  # names of models are few
    said = F.concat(F.lit("exactly one model is needed, found: "), F.array_join(F.array_sort("m"), ", "))
    return sums.select(F.when(F.size("m") == 1, F.element_at("m", 1)).otherwise(F.raise_error(said).cast("string")).alias("model"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, order: distinct values with the place at which each came first."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def pending(wanted: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not in the log of done ones; resuming a run starts from these."""
    return wanted.join(done.select(key), key, "left_anti")


def first_wins(phases: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """One row a key from several phases: the earliest in the order."""
    row = F.min_by(F.struct(*order, *values), F.struct(*order))
    return phases.groupBy(key).agg(row.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in [*order, *values]])


def one_to_one_violations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, left_rows, right_rows of keys that are not exactly once on each side."""
    counted = left.select(F.col(key), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(F.col(key), F.lit(0).alias("l"), F.lit(1).alias("r")))
    sums = counted.groupBy(key).agg(F.sum("l").cast("long").alias("left_rows"), F.sum("r").cast("long").alias("right_rows"))
    return sums.filter("left_rows <> 1 OR right_rows <> 1")
