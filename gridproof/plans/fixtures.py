"""Logs and tables derived from the driver's tables, as DataFrames and as SQL views of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import fmt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_attempts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").withColumn("attempt", F.explode(F.expr("sequence(1, cast(1 + doc_id % 3 as int))")))
    bad = (F.col("doc_id") + F.col("attempt")) % 4 == 0
    return rows.select(
        F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") * 10 + F.col("attempt")).alias("line"), F.when(bad, "judge_error").otherwise("success").alias("judge_status"), F.when(~bad, F.col("quality") == 1).alias("is_correct")
    )


def attacked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 97 != 0, F.col("user_id").cast("string")).alias("source_id"), F.col("event_type").alias("attack_type"),
        F.when(F.col("event_id") % 11 != 0, F.col("value") < 100).alias("is_correct"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    failed = (F.col("conv_id") + F.col("turn")) % 3 == 0
    return table(spark, d, "conversations").filter("role = 'assistant'").select(F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("line"), F.when(failed, "run_failed").otherwise("success").alias("status"), F.col("text").alias("answer"))


def refusals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("judgment_id"), F.concat(F.lit("qa_"), (F.col("user_id") % 40).cast("string")).alias("source_id"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("event_type").alias("attack_type"),
        F.when(k == 0, "full_refusal").when(k == 1, "partial_refusal").when(k == 2, "no_refusal").alias("label"), F.when(k == 0, 1.0).when(k == 1, 0.5).when(k == 2, 0.0).alias("score"),
        F.when(F.col("event_id") % 13 == 0, "judge_error").otherwise("success").alias("judge_status"),
    )


def answers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 7
    price = F.when(k == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    text = F.concat(F.lit("@total["), fmt(price, "0.0000"), F.lit("] @status["), F.when(k == 2, "?").otherwise(F.col("o_orderstatus")), F.lit("]"))
    text = F.when(k == 3, F.concat(F.lit("@total["), fmt(price, "0.0000"), F.lit("]"))).when(k == 4, "").otherwise(text)
    return table(spark, d, "orders").select(F.concat(F.lit("DA_"), F.col("o_orderkey").cast("string"), F.lit("__unit_scale_conversion__001")).alias("id"), F.col("o_orderkey").alias("line"), F.when(k == 5, "run_failed").otherwise("success").alias("status"), text.alias("response"))


def answer_key(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderkey % 7 <> 6")
    field = F.explode(F.array(F.struct(F.lit("total").alias("name"), fmt(F.col("o_totalprice"), "0.00").alias("value")), F.struct(F.lit("status").alias("name"), F.col("o_orderstatus").alias("value"))))
    return o.select(F.col("o_orderkey").cast("string").alias("id"), field.alias("f")).select("id", "f.name", "f.value")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("sample"), F.col("event_type").alias("operator"), F.col("event_id").alias("ordinal"),
        F.when(F.col("event_id") % 5 == 0, "high").otherwise((F.col("event_id") % 10).cast("string")).alias("confidence"), F.length("event_type").cast("int").alias("priority"),
    )


VIEWS = {
    "clean_attempts": """SELECT doc_id::VARCHAR AS id, doc_id * 10 + attempt AS line, CASE WHEN (doc_id + attempt) % 4 = 0 THEN 'judge_error' ELSE 'success' END AS judge_status,
 CASE WHEN (doc_id + attempt) % 4 <> 0 THEN quality = 1 END AS is_correct FROM (SELECT *, unnest(range(1, 2 + doc_id % 3)) AS attempt FROM labels)""",
    "clean": """SELECT id, coalesce(arg_max(is_correct, line) FILTER (WHERE judge_status = 'success' AND is_correct IS NOT NULL), false) AS correct,
 coalesce(max(line) FILTER (WHERE judge_status = 'success' AND is_correct IS NOT NULL), max(line)) AS line, count(*) AS attempts,
 NOT coalesce(bool_or(judge_status = 'success' AND is_correct IS NOT NULL), false) AS all_failed FROM clean_attempts GROUP BY id""",
    "attacked": """SELECT event_id AS id, CASE WHEN event_id % 97 <> 0 THEN user_id::VARCHAR END AS source_id, event_type AS attack_type, CASE WHEN event_id % 11 <> 0 THEN value < 100 END AS is_correct,
 'm' || (user_id % 3) AS model FROM events""",
    "predictions": """SELECT conv_id::VARCHAR AS id, turn AS line, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'run_failed' ELSE 'success' END AS status, text AS answer FROM conversations WHERE role = 'assistant'""",
    "refusals": """SELECT event_id::VARCHAR AS judgment_id, 'qa_' || (user_id % 40) AS source_id, 'm' || (user_id % 3) AS model, event_type AS attack_type,
 CASE event_id % 4 WHEN 0 THEN 'full_refusal' WHEN 1 THEN 'partial_refusal' WHEN 2 THEN 'no_refusal' END AS label, CASE event_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.0::DOUBLE END AS score,
 CASE WHEN event_id % 13 = 0 THEN 'judge_error' ELSE 'success' END AS judge_status FROM events""",
    "answers": """SELECT o_orderkey::VARCHAR AS label_id, 'DA_' || o_orderkey || '__unit_scale_conversion__001' AS id, o_orderkey AS line, CASE WHEN o_orderkey % 7 = 5 THEN 'run_failed' ELSE 'success' END AS status,
 CASE WHEN o_orderkey % 7 = 4 THEN '' WHEN o_orderkey % 7 = 3 THEN '@total[' || format('{:.4f}', o_totalprice) || ']'
 ELSE '@total[' || format('{:.4f}', CASE WHEN o_orderkey % 7 = 1 THEN o_totalprice + 1 ELSE o_totalprice END) || '] @status[' || CASE WHEN o_orderkey % 7 = 2 THEN '?' ELSE o_orderstatus END || ']' END AS response FROM orders""",
    "answer_key": """SELECT o_orderkey::VARCHAR AS id, 'total' AS name, format('{:.2f}', o_totalprice) AS value FROM orders WHERE o_orderkey % 7 <> 6 UNION ALL SELECT o_orderkey::VARCHAR, 'status', o_orderstatus FROM orders WHERE o_orderkey % 7 <> 6""",
    "scores": """SELECT a.id, a.label_id, a.line, CASE WHEN a.status <> 'success' OR trim(a.response) = '' THEN 'run_failed' WHEN k.id IS NULL THEN 'label_not_found' ELSE 'scored' END AS st, k.n, k.names,
 t.value AS tv, s.value AS sv, regexp_extract_all(a.response, '@total\\[(.*?)\\]', 1) AS t_got, regexp_extract_all(a.response, '@status\\[(.*?)\\]', 1) AS s_got
 FROM answers a LEFT JOIN (SELECT id, count(*) AS n, list(name) AS names FROM answer_key GROUP BY id) k ON k.id = a.label_id
 LEFT JOIN answer_key t ON t.id = a.label_id AND t.name = 'total' LEFT JOIN answer_key s ON s.id = a.label_id AND s.name = 'status'""",
    "scored": """SELECT id, label_id, line, st AS status, CASE WHEN st = 'scored' THEN n END AS n_fields,
 CASE WHEN st = 'scored' THEN (coalesce(t_got[-1] = tv OR abs(try_cast(t_got[-1] AS DOUBLE) - try_cast(tv AS DOUBLE)) < 1e-6, false))::BIGINT + (coalesce(s_got[-1] = sv, false))::BIGINT END AS n_right,
 CASE WHEN st = 'scored' THEN concat_ws(',', CASE WHEN len(s_got) > 0 AND s_got[-1] <> sv THEN 'status' END, CASE WHEN len(t_got) > 0 AND NOT (t_got[-1] = tv OR abs(try_cast(t_got[-1] AS DOUBLE) - try_cast(tv AS DOUBLE)) < 1e-6) THEN 'total' END) END AS wrong,
 CASE WHEN st = 'scored' THEN concat_ws(',', CASE WHEN len(s_got) = 0 THEN 'status' END, CASE WHEN len(t_got) = 0 THEN 'total' END) END AS missing FROM scores""",
    "candidates": """SELECT user_id AS sample, event_type AS operator, event_id AS ordinal, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE event_id % 10 END::DOUBLE AS confidence, length(event_type)::INTEGER AS priority FROM events""",
    "best": """SELECT sample, operator, arg_max(ordinal, struct_pack(c := confidence, o := -ordinal)) AS ordinal, max(confidence) AS confidence, any_value(priority) AS priority FROM candidates GROUP BY sample, operator""",
}
_NEEDS = {"clean": ["clean_attempts"], "scores": ["answers", "answer_key"], "scored": ["answers", "answer_key", "scores"], "best": ["candidates"]}


def with_views(sql: str, *views: str) -> str:
    names: list[str] = []
    for v in views:
        names += [x for x in [*_NEEDS.get(v, []), v] if x not in names]
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + sql


def rounded(x: str, digits: int) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN format('{{:.{digits}f}}', ({x})::DOUBLE)::DOUBLE END"


def ratio(part: str, whole: str, digits: int = 6) -> str:
    return rounded(f"CASE WHEN ({whole}) > 0 THEN ({part})::DOUBLE / ({whole})::DOUBLE END", digits)


def robust_sql(policy: str, by: list[str], more: str = "") -> str:
    keys = "".join(f"{b}, " for b in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    used = "m" if policy == "incorrect" else "m AND is_correct IS NOT NULL"
    body = f"""
, pairs AS (SELECT a.id, a.source_id, a.is_correct, a.model, coalesce(nullif(a.attack_type, ''), '__missing_attack_type__') AS attack_type, c.correct AS cc, (coalesce(a.source_id, '') <> '' AND c.id IS NOT NULL) AS m
 FROM attacked a LEFT JOIN clean c ON a.source_id = c.id),
src AS (SELECT {keys}source_id, cc, count(*) AS records, count(*) FILTER (WHERE m) AS paired, count(*) FILTER (WHERE coalesce(trim(source_id), '') = '') AS missing, count(*) FILTER (WHERE m AND is_correct IS NULL) AS unscored,
 count(*) FILTER (WHERE {used}) AS n, count(*) FILTER (WHERE {used} AND coalesce(is_correct, false)) AS r FROM pairs GROUP BY {keys}source_id, cc),
sums AS (SELECT {keys}sum(records)::BIGINT AS attack_records, sum(paired)::BIGINT AS paired_records, sum(missing)::BIGINT AS missing_source, sum(unscored)::BIGINT AS attacked_unscored, sum(n)::BIGINT AS evaluated,
 coalesce(sum(n) FILTER (WHERE cc), 0)::BIGINT AS support, sum(r)::BIGINT AS attacked_right, coalesce(sum(r) FILTER (WHERE cc), 0)::BIGINT AS stable_correct, coalesce(sum(r) FILTER (WHERE NOT cc), 0)::BIGINT AS improved,
 coalesce(sum(n - r) FILTER (WHERE cc), 0)::BIGINT AS attack_successes, coalesce(sum(n - r) FILTER (WHERE NOT cc), 0)::BIGINT AS base_failures,
 avg(r::DOUBLE / n) FILTER (WHERE cc AND n > 0) AS mean_right, coalesce(sum(1 - r::DOUBLE / n) FILTER (WHERE cc AND n > 0), 0) AS lost, count(*) FILTER (WHERE paired > 0) AS sources, count(*) FILTER (WHERE cc AND n > 0) AS counted_sources FROM src {group}),
whole AS (SELECT count(*) AS unique_clean_records, count(*) FILTER (WHERE correct) AS clean_right FROM clean),
r1 AS (SELECT *, {ratio("support", "evaluated")} AS original_correct_rate, {ratio("attacked_right", "evaluated")} AS attacked_correct_rate, {ratio("clean_right", "unique_clean_records")} AS clean_dataset_accuracy,
 {ratio("lost", "unique_clean_records")} AS robustness_accuracy_drop FROM sums, whole)
SELECT {keys}attack_records, paired_records, attack_records - paired_records AS unmatched_clean, missing_source, attacked_unscored, evaluated, support, stable_correct, attack_successes, improved, base_failures,
 original_correct_rate, attacked_correct_rate, {rounded("original_correct_rate - attacked_correct_rate", 6)} AS accuracy_drop, {ratio("stable_correct", "support")} AS conditional_robust_accuracy,
 {ratio("attack_successes", "support")} AS attack_success_rate, unique_clean_records, clean_dataset_accuracy, {rounded("mean_right", 6)} AS source_balanced_cra, {rounded("1 - mean_right", 6)} AS source_balanced_asr,
 robustness_accuracy_drop, {rounded("clean_dataset_accuracy - robustness_accuracy_drop", 6)} AS robust_accuracy, {ratio("sources", "unique_clean_records")} AS attack_coverage{more} FROM r1"""
    return with_views("", "attacked", "clean").rstrip() + body
