"""Paired robustness metrics: attacked judgments against clean ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import fmt, plain, q, rate

MISSING = "__missing_attack_type__"
#: Levels of the operators in catalog order.
LEVELS = {
    "row_order_shuffle": "L0", "column_order_shuffle": "L0", "header_synonym_substitution": "L0", "semantic_distractor_column": "L0",
    "equivalent_value_reencoding": "L1", "unit_scale_conversion": "L1",
    "csv_wide_long_reshape": "L2", "csv_relational_decomposition": "L2", "excel_hierarchical_header_relayout": "L2", "excel_cross_sheet_relayout": "L2",
    "decoy_feature_pack_injection": "L3", "non_observation_row_injection": "L3",
}


#: The columns of the metric table, in order.
METRIC_COLUMNS = [
    "group", "attack_records", "paired_records", "original_correct_rate", "attacked_correct_rate", "accuracy_drop", "conditional_robust_accuracy", "attack_success_rate",
    "clean_dataset_accuracy", "robust_accuracy", "robustness_accuracy_drop", "unique_clean_records", "clean_dataset_correct", "attacked_unique_sources", "attack_coverage",
    "source_clean_correct_support", "source_balanced_cra", "source_balanced_asr", "support_clean_correct", "stable_correct", "attack_successes",
    "clean_incorrect_attack_correct", "clean_incorrect_attack_incorrect", "clean_unscored", "attacked_unscored", "unmatched_clean",
]


def level(operator):
    """The level of an operator, null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), operator)


def pair(attacked: DataFrame, clean: DataFrame) -> DataFrame:
    """Each attacked record with the clean outcome of its source (clean_correct, null where there is none) and `reason` for that."""
    sources = clean.select(F.col("id").alias("source_id"), F.col("correct").alias("clean_correct"))
    named = F.trim("source_id") != ""  # others would all meet under one key
    joined = attacked.filter(named).join(sources, "source_id", "left").unionByName(attacked.filter(~F.coalesce(named, F.lit(False))), allowMissingColumns=True)
    reason = F.when(F.coalesce(F.trim("source_id"), F.lit("")) == "", "missing_source_id").when(F.col("clean_correct").isNull(), "clean_source_not_found")
    return joined.withColumn("reason", reason).withColumn("attack_type", F.coalesce(F.nullif(F.col("attack_type"), F.lit("")), F.lit(MISSING)))


def robust_summary(attacked: DataFrame, clean: DataFrame, policy: str = "incorrect", by: list[str] | None = None) -> DataFrame:
    """All robustness metrics, over all records or for each value of `by`.

    policy: an attacked record without an outcome counts as wrong (incorrect) or leaves its pair out (exclude).
    Outcomes are counted by source first, with partial sums, and the rates are taken from those counts, so a hot attack type or source is
    one row a task. Denominators over the clean set always take the whole of it.
    """
    return _rates(_by_source(attacked, clean, policy, by or []), clean, by or []).select(
        *(by or []), "attack_records", "paired_records", "unmatched_clean", "missing_source", "attacked_unscored", "evaluated", "support", "stable_correct", "attack_successes", "improved", "base_failures",
        "original_correct_rate", "attacked_correct_rate", "accuracy_drop", "conditional_robust_accuracy", "attack_success_rate", "unique_clean_records", "clean_dataset_accuracy",
        "source_balanced_cra", "source_balanced_asr", "robustness_accuracy_drop", "robust_accuracy", "attack_coverage",
    )


def metric_table(attacked: DataFrame, clean: DataFrame, policy: str = "incorrect") -> DataFrame:
    """METRIC_COLUMNS with position: one row overall (position 0), then one for each attack type by name.

    Pairs are joined and counted by attack type and source once; the overall row sums these counts by source.
    """
    counts = _by_source(attacked, clean, policy, ["attack_type"])
    numbers = [c for c in counts.columns if c not in ("attack_type", "source_id", "clean_correct")]
    every = counts.groupingSets([["attack_type", "source_id", "clean_correct"], ["source_id", "clean_correct"]], "attack_type", "source_id", "clean_correct").agg(
        *[F.sum(c).alias(c) for c in numbers], (F.grouping("attack_type") == 1).alias("overall")
    )
    rows = _rates(every, clean, ["overall", "attack_type"])
    named = rows.withColumns({
        "group": F.when(F.col("overall"), "overall").otherwise(F.col("attack_type")), "clean_dataset_correct": F.col("clean_right"), "attacked_unique_sources": F.col("sources"),
        "source_clean_correct_support": F.col("counted_sources"), "support_clean_correct": F.col("support"), "clean_incorrect_attack_correct": F.col("improved"), "clean_incorrect_attack_incorrect": F.col("base_failures"),
    })
    place = F.row_number().over(Window.orderBy(F.desc("overall"), "group")) - 1  # one row a group
    return named.select(*METRIC_COLUMNS, place.cast("long").alias("position"))


def _by_source(attacked: DataFrame, clean: DataFrame, policy: str, by: list[str]) -> DataFrame:
    if policy not in ("incorrect", "exclude"):
        raise ValueError(f"unknown policy {policy}")
    pairs = pair(attacked, clean)
    matched = F.col("reason").isNull()
    used = matched & (F.lit(True) if policy == "incorrect" else F.col("is_correct").isNotNull())
    won = F.coalesce(F.col("is_correct"), F.lit(False))
    return pairs.groupBy(*by, "source_id", "clean_correct").agg(
        F.count("*").alias("records"), F.count_if(matched).alias("paired"), F.count_if(F.col("reason") == "missing_source_id").alias("missing"),
        F.count_if(matched & F.col("is_correct").isNull()).alias("unscored"), F.count_if(matched & F.col("clean_correct").isNull()).alias("clean_unscored"), F.count_if(used).alias("n"), F.count_if(used & won).alias("right"),
    )


def _rates(by_source: DataFrame, clean: DataFrame, by: list[str]) -> DataFrame:
    good, bad = F.col("clean_correct"), ~F.col("clean_correct")
    total = lambda c, when=F.lit(True): F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    share = F.col("right").cast("double") / F.col("n")
    sums = by_source.groupBy(*by).agg(
        total("records").alias("attack_records"), total("paired").alias("paired_records"), total("missing").alias("missing_source"), total("unscored").alias("attacked_unscored"),
        total("n").alias("evaluated"), total("n", good).alias("support"), total("right").alias("attacked_right"),
        total("right", good).alias("stable_correct"), total("right", bad).alias("improved"), (total("n", good) - total("right", good)).alias("attack_successes"), (total("n", bad) - total("right", bad)).alias("base_failures"),
        F.avg(F.when(good & (F.col("n") > 0), share)).alias("mean_right"), F.coalesce(F.sum(F.when(good & (F.col("n") > 0), 1 - share)), F.lit(0.0)).alias("lost"),
        F.count_if(F.col("paired") > 0).alias("sources"), F.count_if(good & (F.col("n") > 0)).alias("counted_sources"), total("clean_unscored").alias("clean_unscored"),
    )
    whole = clean.agg(F.count("*").alias("unique_clean_records"), F.count_if("correct").alias("clean_right"))
    out = sums.crossJoin(F.broadcast(whole))  # one row
    return out.withColumns({
        "unmatched_clean": F.col("attack_records") - F.col("paired_records"),
        "original_correct_rate": rate(F.col("support"), F.col("evaluated")),
        "attacked_correct_rate": rate(F.col("attacked_right"), F.col("evaluated")),
        "conditional_robust_accuracy": rate(F.col("stable_correct"), F.col("support")),
        "attack_success_rate": rate(F.col("attack_successes"), F.col("support")),
        "clean_dataset_accuracy": rate(F.col("clean_right"), F.col("unique_clean_records")),
        "source_balanced_cra": q(F.col("mean_right"), 6),
        "source_balanced_asr": q(1 - F.col("mean_right"), 6),
        "robustness_accuracy_drop": rate(F.col("lost"), F.col("unique_clean_records")),
        "attack_coverage": rate(F.col("sources"), F.col("unique_clean_records")),
    }).withColumns({
        "accuracy_drop": q(F.col("original_correct_rate") - F.col("attacked_correct_rate"), 6),
        "robust_accuracy": q(F.col("clean_dataset_accuracy") - F.col("robustness_accuracy_drop"), 6),
    })


def unmatched(attacked: DataFrame, clean: DataFrame) -> DataFrame:
    """Attacked records without a clean partner, and why."""
    return pair(attacked, clean).filter("reason IS NOT NULL").select("id", "source_id", "attack_type", "reason")


def operator_asr(attacked: DataFrame, clean: DataFrame, by: list[str], percent: bool = True) -> DataFrame:
    """by, asr (percent or fraction), support, attack_successes, cra, paired_records, unmatched_clean."""
    rows = robust_summary(attacked, clean, "incorrect", by)
    scale = 100.0 if percent else 1.0
    return rows.select(*by, q(F.col("attack_success_rate") * scale, 6).alias("asr"), "support", "attack_successes", q(F.col("conditional_robust_accuracy") * scale, 6).alias("cra"), "paired_records", "unmatched_clean")


def asr_cell(asr, support):
    """25.00% (n=8); N/A without support."""
    return F.when(asr.isNull(), "N/A").otherwise(F.concat(fmt(asr, "0.00"), F.lit("% (n="), support.cast("string"), F.lit(")")))


def asr_matrix(rows: DataFrame, row_keys: list[str], column: str, columns: list[str]) -> DataFrame:
    """One row for each of row_keys, one column of cells for each model; -- where a cell has no record."""
    cells = rows.withColumn("cell", asr_cell(F.col("asr"), F.col("support")))
    return cells.groupBy(*row_keys).pivot(column, columns).agg(F.first("cell")).fillna("--", columns)


def batch_scores(attacked: DataFrame, clean: DataFrame, by: list[str]) -> DataFrame:
    """by, asr, rad as text without trailing zeros."""
    rows = robust_summary(attacked, clean, "incorrect", by)
    return rows.select(*by, plain(F.col("attack_success_rate")).alias("asr"), plain(F.col("robustness_accuracy_drop")).alias("rad"))
