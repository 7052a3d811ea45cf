"""Gates between selection, construction and judgment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_CONFIDENCE = 0.7
#: Failures after which a construction is tried again, and final ones.
RETRYABLE = ("attack_not_effective", "answer_changed", "unanswerable", "ambiguity_introduced", "evidence_lost", "invalid_file")
FINAL = ("judge_error", "unverifiable")


def selection_closure(choices: DataFrame, enabled: DataFrame) -> DataFrame:
    """sample, operator, issue: operators that are unknown, chosen twice, or left out. choices: sample, operator; enabled: operator (a small catalog)."""
    counted = choices.groupBy("sample", "operator").agg(F.count("*").alias("n"))
    wanted = choices.select("sample").distinct().crossJoin(F.broadcast(enabled.select("operator", F.lit(True).alias("enabled"))))
    both = wanted.join(counted, ["sample", "operator"], "full")
    issue = F.when(F.col("enabled").isNull(), "unknown_operator").when(F.col("n").isNull(), "omitted_operator").when(F.col("n") > 1, "duplicate_operator")
    return both.select("sample", "operator", issue.alias("issue")).filter("issue IS NOT NULL")


def confidence_gate(choices: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Eligible choices of too little confidence become ineligible, with the reason."""
    low = F.col("eligible") & (F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)) < least)
    return choices.withColumns({"eligible": F.col("eligible") & ~low, "reason": F.when(low, "below_confidence_threshold").otherwise(F.col("reason"))})


def first_failure(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All columns with accepted and failed: the first rule, in order, that is not true."""
    failed = F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return rows.withColumns({"accepted": failed.isNull(), "failed": failed})


def judge_gate(results: DataFrame) -> DataFrame:
    """The order of checks of a judged answer-preserving result: verdict, answers, evidence, differences, audits."""
    return first_failure(results, {
        "verdict": F.col("verdict") == "valid", "answer_missing": F.coalesce(F.trim(F.col("answer").cast("string")) != "", F.lit(False)),
        "evidence_missing": F.size("evidence") > 0, "reference_mismatch": F.size("differences") == 0, "audit_count": F.size("audits") == F.col("declared"), "audit_failed": F.forall("audits", lambda a: a),
    })


def refusal_gate(results: DataFrame) -> DataFrame:
    """The order of checks of an answer-destroying result: it can't be answered, should be refused, nothing is made up, and hard ones are hard."""
    return first_failure(results, {
        "verdict": F.col("verdict") == "valid", "can_answer": ~F.col("can_answer"), "should_refuse": F.col("should_refuse"), "fabricated_answer": ~F.coalesce(F.col("fabricated_answer"), F.lit(False)),
        "hardness_valid": (F.col("level") != "hard") | F.col("hardness_valid"), "files_missing": (F.size("files_before") > 0) & (F.size("files_after") > 0),
    })


def retry_class(category: Column) -> Column:
    """accepted (no failure), repair, final or reject, by the category of a failure."""
    return F.when(category.isNull(), "accepted").when(category.isin(*RETRYABLE), "repair").when(category.isin(*FINAL), "final").otherwise("reject")


def recover(log: DataFrame, accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """sample, operator, status: stored results override the log; a fatal error after a selection is eligible again."""
    keys = ["sample", "operator"]
    rows = log.join(accepted.select(*keys, F.lit(True).alias("_a")).distinct(), keys, "left").join(rejected.select(*keys, F.lit(True).alias("_r")).distinct(), keys, "left")
    status = F.when(F.col("_a"), "accepted").when(F.col("_r"), "rejected").when((F.col("status") == "fatal_error") & F.col("selected"), "eligible").otherwise(F.col("status"))
    return rows.select(*keys, status.alias("status"))


#: Evidence fields that a repair may see.
FEEDBACK_FIELDS = ("original_files", "attacked_files", "fields", "filters", "joins", "units", "transformation_checks")


def repair_feedback(results: DataFrame, longest: int = 1200) -> DataFrame:
    """id, evidence (only the fields that a repair may see), reason cut to a length. results: id, evidence map<string,string>, reason."""
    seen = F.map_filter("evidence", lambda k, _: k.isin(*FEEDBACK_FIELDS))
    return results.select("id", seen.alias("evidence"), F.substring("reason", 1, longest).alias("reason"))


def catalog_order(rows: DataFrame, operator: str, known: list[str]) -> DataFrame:
    """rows with catalog_index: known operators by their place in the catalog, unknown ones after them."""
    place = F.array_position(F.array(*[F.lit(x) for x in known]), F.col(operator)) - 1
    return rows.withColumn("catalog_index", F.when(place >= 0, place).otherwise(len(known)).cast("int"))


#: What a validator has to affirm, in the order of the checks, and operators that must be hard.
CORE_FIELDS = ("independent_check_completed", "original_answerable", "attack_rule_valid", "question_preservation_valid", "file_edit_scope_valid", "unique_answer_impossible", "no_alternative_answer_path")
HARD_OPERATORS = ("deep_analysis_missing", "structural_context_missing")


def validator_gate(results: DataFrame) -> DataFrame:
    """All columns with accepted, failed and reason: the first field of a validator's result that is not as it must be, and what it says.

    results: operator, verdict, the CORE_FIELDS, hardness_valid, can_answer, should_refuse, fabricated_answer (booleans, null where not given), original_files_checked and
    final_files_checked (arrays), failure_reason, refusal_reason. A verdict that is not `passed` gives the reason that the validator states itself.
    """
    hard = F.col("operator").isin(*HARD_OPERATORS)
    seen = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = {"verdict": F.col("verdict") == "passed"} | {c: true(c) for c in CORE_FIELDS}
    rules |= {"hardness_valid": ~hard | true("hardness_valid"), "can_answer": ~F.coalesce("can_answer", F.lit(True)), "should_refuse": true("should_refuse"), "fabricated_answer": ~true("fabricated_answer")}
    rules |= {"original_files_checked": seen("original_files_checked"), "final_files_checked": seen("final_files_checked")}
    gated = first_failure(results, rules)
    told = F.when(F.col("failed") == "verdict", F.coalesce("failure_reason", "refusal_reason", F.concat(F.lit("verdict="), F.coalesce("verdict", F.lit("null"))))).when(F.col("failed").endswith("_checked"), F.concat(F.lit("evidence missing: "), F.col("failed")))
    return gated.withColumn("reason", F.when(F.col("failed").isNotNull(), F.coalesce(told, F.concat(F.lit("field failed: "), F.col("failed")))))
