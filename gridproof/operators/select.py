"""Choice of perturbations for samples, and the gates that accept results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_candidates(candidates: DataFrame) -> DataFrame:
    """One candidate a sample and operator: the greatest confidence, the first on a tie; unreadable confidence is 0."""
    c = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))
    rows = candidates.withColumn("confidence", c)
    best = F.max_by(F.struct("ordinal", "confidence", "priority"), F.struct("confidence", -F.col("ordinal")))
    return rows.groupBy("sample", "operator").agg(best.alias("b")).select("sample", "operator", "b.ordinal", "b.confidence", "b.priority")


def select_attacks(candidates: DataFrame, most: int | None) -> DataFrame:
    """sample, operator, position, status, reason: by priority, then confidence; those beyond the limit are logged as such."""
    order = Window.partitionBy("sample").orderBy("priority", F.desc("confidence"), "operator")  # a sample has at most one row an operator
    rows = best_candidates(candidates).withColumn("position", F.row_number().over(order))
    kept = F.lit(True) if most is None else F.col("position") <= most
    return rows.select("sample", "operator", F.col("position").cast("long").alias("position"), F.when(kept, "selected").otherwise("skipped").alias("status"), F.when(~kept, "max_attacks_limit").alias("reason"))


def first_rejections(rejections: DataFrame, eligible: DataFrame) -> DataFrame:
    """The first reason listed for each sample and operator that is not eligible."""
    rest = rejections.join(eligible.select("sample", "operator"), ["sample", "operator"], "left_anti")
    return rest.groupBy("sample", "operator").agg(F.min_by("reason", "ordinal").alias("reason"))


def acceptance_gate(results: DataFrame, required_true: list[str], required_false: list[str]) -> DataFrame:
    """id, accepted, failed_field: the first required field that is not as it must be; nulls fail a required true and pass a required false."""
    bad = [F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in required_true] + [F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in required_false]
    failed = F.coalesce(*bad)
    return results.select("id", failed.isNull().alias("accepted"), failed.alias("failed_field"))


def resume_summary(states: DataFrame, terminal: list[str]) -> DataFrame:
    """loaded, completed, remaining samples: a sample is complete when all its operators are in a terminal state."""
    rows = states.groupBy("sample").agg(F.bool_and(F.coalesce(F.col("status").isin(*terminal), F.lit(False))).alias("done"))
    return rows.agg(F.count("*").alias("loaded"), F.count_if("done").alias("completed"), F.count_if(~F.col("done")).alias("remaining"))


def status_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("sample", "status").agg(F.count("*").alias("n"))


def assistant_rounds(messages: DataFrame) -> DataFrame:
    """conv_id, rounds, tool_calls of traces with one row a message."""
    return messages.groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("rounds"), F.count_if(F.col("role") == "tool").alias("tool_calls"))


#: Least confidence where an operator has none of its own, and the stages at which a candidate can end, in the order of the checks.
LEAST_CONFIDENCE = 0.65
STAGES = ("model_omitted", "model_rejected", "static_ineligible", "below_confidence_threshold", "max_attacks_limit")


def selection_log(candidates: DataFrame, samples: DataFrame, operators: DataFrame, most: int | None = None, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """sample, operator, status, stage, position, confidence, reason: what became of each enabled operator for each sample, in one pass.

    candidates: sample, operator, verdict (eligible or rejected), ordinal, confidence (text), reason; samples: sample, file_count; operators (a small catalog): operator, priority,
    min_confidence, least_files. Of several eligible entries of an operator the one with the greatest confidence counts, the first on a tie; unreadable confidence is 0. An eligible entry outweighs rejections, of
    which the first counts. An entry that needs more files than the sample has is ineligible, one below the operator's least confidence (or the general one) fails, and those left are taken by
    priority, confidence and first mention, up to `most` (all enabled ones by default). Operators without an entry are omitted ones; entries of operators that are not enabled count for nothing.
    """
    eligible, rejected = F.col("verdict") == "eligible", F.col("verdict") == "rejected"
    c = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))
    said = candidates.groupBy("sample", "operator").agg(
        F.max(F.when(eligible, c)).alias("best"), F.min(F.when(eligible, F.col("ordinal"))).alias("first"), F.max_by(F.col("reason"), F.when(eligible, F.struct(c, -F.col("ordinal")))).alias("why"),
        F.min_by(F.struct(F.col("reason").alias("why"), F.col("confidence").try_cast("double").alias("confidence")), F.when(rejected, F.col("ordinal"))).alias("no"),
    )
    grid = samples.select("sample", "file_count").crossJoin(F.broadcast(operators.select("operator", "priority", "min_confidence", "least_files")))  # one row an operator
    rows = grid.join(said, ["sample", "operator"], "left")
    stage = (
        F.when(F.col("best").isNull(), F.when(F.col("no").isNull(), STAGES[0]).otherwise(STAGES[1]))
        .when(F.col("file_count") < F.col("least_files"), STAGES[2]).when(F.col("best") < F.coalesce("min_confidence", F.lit(least)), STAGES[3])
    )
    judged = rows.withColumn("stage", stage)
    order = Window.partitionBy("sample", "stage").orderBy(F.coalesce("priority", F.lit(999)), F.desc("best"), "first")  # the operators of a sample
    placed = judged.withColumn("position", F.when(F.col("stage").isNull(), F.row_number().over(order)))
    late = F.col("position") > (F.lit(most) if most is not None else F.lit(1 << 30))
    ended = F.coalesce("stage", F.when(late, STAGES[4]))
    return placed.select(
        "sample", "operator", F.when(ended.isNull(), "selected").otherwise("rejected").alias("status"), ended.alias("stage"), F.col("position").cast("long").alias("position"),
        F.coalesce("best", "no.confidence").alias("confidence"), F.coalesce("why", "no.why").alias("reason"),
    )
