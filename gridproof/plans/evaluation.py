"""Queries of outcomes, projections, names and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, parse
from ..operators import canonical, files, reliability, robust, scoring, select
from ..sources import grid
from . import fixtures as fx
from .fixtures import robust_sql, rounded, table, with_views
from .registry import query

_MORE = ", clean_right AS clean_dataset_correct, sources AS attacked_unique_sources, counted_sources AS source_clean_correct_support, support AS support_clean_correct, improved AS clean_incorrect_attack_correct, base_failures AS clean_incorrect_attack_incorrect, 0::BIGINT AS clean_unscored"


def _table_sql(policy: str) -> str:
    columns = ", ".join(c for c in robust.METRIC_COLUMNS if c != "group")
    return f"""SELECT 'overall' AS "group", {columns}, 0::BIGINT AS position FROM ({robust_sql(policy, [], _MORE)})
UNION ALL SELECT attack_type, {columns}, row_number() OVER (ORDER BY attack_type) FROM ({robust_sql(policy, ["attack_type"], _MORE)})"""


@query(_table_sql("incorrect"))
def metric_table(s, d):
    return robust.metric_table(fx.attacked(s, d), canonical.canonical_clean(fx.clean_attempts(s, d)))


@query(_table_sql("exclude"))
def metric_table_exclude(s, d):
    return robust.metric_table(fx.attacked(s, d), canonical.canonical_clean(fx.clean_attempts(s, d)), "exclude")


_OPERATORS = {"click": "row_order_shuffle", "view": "equivalent_value_reencoding", "purchase": "csv_wide_long_reshape", "signup": "decoy_feature_pack_injection"}
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _OPERATORS.items())


@query(f"""SELECT model, CASE attack_type {_CASES} ELSE 'unknown_operator' END AS attack_type, CASE attack_type WHEN 'click' THEN 'L0' WHEN 'view' THEN 'L1' WHEN 'purchase' THEN 'L2' WHEN 'signup' THEN 'L3' END AS level,
 {rounded('attack_success_rate * 100', 6)} AS asr, support FROM ({robust_sql('incorrect', ['model', 'attack_type'])})""")
def operator_asr_levels(s, d):
    name = F.element_at(F.create_map(*[F.lit(x) for kv in _OPERATORS.items() for x in kv]), F.col("attack_type"))
    attacked = fx.attacked(s, d).withColumn("attack_type", F.coalesce(name, F.lit("unknown_operator")))
    rows = robust.operator_asr(attacked, canonical.canonical_clean(fx.clean_attempts(s, d)), ["model", "attack_type"])
    return rows.select("model", "attack_type", robust.level(F.col("attack_type")).alias("level"), "asr", "support")


def _legacy(s, d):
    rows = table(s, d, "labels").withColumn("attempt", F.explode(F.expr("sequence(1, cast(1 + doc_id % 3 as int))")))
    k = (F.col("doc_id") + F.col("attempt")) % 4
    score = F.when(F.col("doc_id") % 7 == 0, F.lit(float("nan"))).when(F.col("doc_id") % 7 == 1, F.lit(float("inf"))).otherwise(F.col("quality").cast("double"))
    return rows.select(
        F.concat(F.lit("DA_"), F.col("doc_id").cast("string")).alias("id"), (F.col("doc_id") * 10 + F.col("attempt")).alias("line"), F.when(k == 0, "judge_error").when(k == 1, "success").alias("judge_status"),
        F.when(k == 3, F.col("toxic") == 1).alias("is_correct"), score.alias("score"),
    )


@query("""WITH a AS (SELECT doc_id, attempt, doc_id * 10 + attempt AS line, (doc_id + attempt) % 4 AS k, quality, toxic FROM (SELECT *, unnest(range(1, 2 + doc_id % 3)) AS attempt FROM labels)),
o AS (SELECT 'DA_' || doc_id AS id, line, CASE WHEN k = 0 THEN NULL WHEN k = 3 THEN toxic = 1 WHEN doc_id % 7 > 1 THEN quality = 1 END AS x FROM a)
SELECT id, coalesce(arg_max(x, line) FILTER (WHERE x IS NOT NULL), false) AS correct, coalesce(max(line) FILTER (WHERE x IS NOT NULL), max(line)) AS line, count(*) AS attempts, count(x) = 0 AS all_failed FROM o GROUP BY id""")
def canonical_clean_by_score(s, d):
    return canonical.canonical_clean(_legacy(s, d))


@query(with_views("SELECT id, label_id, line, status, n_right = n_fields AS correct, n_fields, n_right, wrong, missing FROM scored", "scored"))
def repeated_label_names(s, d):
    labels = fx.answer_key(s, d).withColumn("ordinal", F.lit(2))
    earlier = labels.filter("name = 'status'").withColumns({"value": F.lit("an earlier line"), "ordinal": F.lit(1)})
    return scoring.score_answers(fx.answers(s, d), labels.unionByName(earlier))


def _fields(s, d):
    c, text = table(s, d, "conversations"), F.col("text")
    k = F.col("turn") % 5
    return c.select(
        "conv_id", "turn", F.when(k == 0, text).when(k == 1, F.lit(" \n")).alias("final"), F.when(k == 1, F.lit("\t")).when(k == 2, F.concat(F.lit("raw "), text)).alias("raw"),
        F.when(k == 3, text).when(k == 4, F.lit("")).alias("model_response"), F.when(k == 4, F.concat(F.lit("older "), text)).alias("response"), F.when(k == 1, F.lit("old")).alias("legacy"),
    )


@query("""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN 'old' WHEN 2 THEN 'raw ' || text WHEN 3 THEN text ELSE 'older ' || text END AS judged,
CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN chr(9) WHEN 2 THEN 'raw ' || text ELSE '' END AS refused FROM (SELECT conv_id, turn, text FROM conversations)""")
def answer_projections(s, d):
    f = [F.col(c) for c in ("final", "raw", "model_response", "response", "legacy")]
    return _fields(s, d).select("conv_id", "turn", parse.answer_to_judge(*f).alias("judged"), parse.answer_to_refuse(f[0], f[1]).alias("refused"))


@query("SELECT 'bench' AS model")
def single_model(s, d):
    k = F.col("event_id") % 4
    return canonical.single_model(table(s, d, "events").select(F.when(k == 0, "bench").when(k == 1, " bench ").when(k == 2, " ").alias("model")))


@query("SELECT event_id, (CASE WHEN event_id % 3 > 0 THEN user_id ELSE 0 END + CASE WHEN event_id % 5 > 0 THEN event_id % 100 ELSE 0 END)::BIGINT AS tokens FROM events")
def generated_tokens(s, d):
    a, b = F.when(F.col("event_id") % 3 > 0, F.col("user_id")), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 100)
    return table(s, d, "events").select("event_id", parse.generated_tokens(a, b).alias("tokens"))


@query("""SELECT name, row_number() OVER (ORDER BY replace(lower(name), 'ß', 'ss'), name)::INTEGER AS position FROM (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type || 'ß' END AS name FROM events)""")
def names_in_folded_order(s, d):
    from pyspark.sql import Window

    name = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat("event_type", F.lit("ß")))
    names = table(s, d, "events").select(name.alias("name")).distinct()  # names of operators: few
    return names.withColumn("position", F.row_number().over(Window.orderBy(parse.folded(F.col("name")), "name")))


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def first_seen_users(s, d):
    return canonical.first_seen(table(s, d, "events"), "user_id", "event_id")


@query(with_views("SELECT count(*) AS original, count(*) FILTER (WHERE NOT x) AS retained, count(*) FILTER (WHERE x) AS excluded, 14::BIGINT AS requested_ids, count(DISTINCT source_id) FILTER (WHERE x) AS matched_ids FROM (SELECT *, upper(source_id) IN ('QA_19', 'QA_20', 'QA_73', 'QA_74', 'QA_75', 'QA_76', 'QA_77', 'QA_78', 'QA_79', 'QA_94', 'QA_96', 'QA_107', 'QA_113', 'QA_115') AS x FROM refusals)", "refusals"))
def exclusion_totals(s, d):
    return reliability.exclusion_totals(fx.refusals(s, d))


@query("""SELECT event_id, CASE WHEN k IN (1, 3) THEN 1 ELSE 0 END::INTEGER AS score, CASE k WHEN 0 THEN 'incorrect' WHEN 1 THEN 'correct' WHEN 2 THEN 'correct' WHEN 3 THEN 'correct' ELSE 'incorrect' END AS label FROM (SELECT event_id, event_id % 7 AS k FROM events)""")
def correctness_payloads(s, d):
    k = F.col("event_id") % 7
    score = F.when(k == 0, "0.7").when(k == 1, " 1.9").when(k == 2, "2").when(k == 3, "1").when(k == 4, "one").when(k == 5, "NaN")
    label = F.when(k == 2, " correct ").when(k == 4, "wrong")
    x = parse.correctness_score(score)
    return table(s, d, "events").select("event_id", x.alias("score"), parse.correctness_label(label, x).alias("label"))


@query("SELECT event_id, CASE WHEN event_id % 6 = 4 THEN event_id + 1 END AS n FROM events")
def optional_numbers(s, d):
    k = F.col("event_id") % 6
    text = F.when(k == 0, " ").when(k == 1, "None").when(k == 2, "null").when(k == 3, "0").when(k == 4, F.concat(F.lit(" "), (F.col("event_id") + 1).cast("string"))).otherwise("x")
    return table(s, d, "events").select("event_id", parse.optional_number(text).alias("n"))


@query("SELECT user_id AS sample, event_type AS operator, arg_min('r' || (event_id % 5), event_id) AS reason FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = e.event_type AND x.value > 150) GROUP BY 1, 2")
def first_rejection_reasons(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("operator"), F.col("event_id").alias("ordinal"), F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string")).alias("reason"), "value")
    return select.first_rejections(e, e.filter("value > 150").select("sample", "operator").distinct())


@query("SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 2 = 0 THEN 'QA_' ELSE 'da_' END, c_custkey)::INTEGER AS position FROM customer")
def natural_sort(s, d):
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "QA_").otherwise("da_"), F.col("c_custkey").cast("string"))
    order = {f"_k{i}": k for i, k in enumerate(ids.natural_order(name))}
    rows = grid.number_rows(table(s, d, "customer").select("c_custkey", *[k.alias(n) for n, k in order.items()]), list(order), "position")
    return rows.select("c_custkey", F.col("position").cast("int").alias("position"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 < 4 THEN c_custkey END AS k FROM customer")
def salvaged_json(s, d):
    k, body = F.col("c_custkey") % 5, F.concat(F.lit('{"k": '), F.col("c_custkey").cast("string"), F.lit("}"))
    text = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), body, F.lit(" as asked"))).when(k == 3, F.concat(F.lit("```\n"), body, F.lit("```"))).otherwise("{no")
    return table(s, d, "customer").select("c_custkey", F.try_variant_get(parse.salvage_json(text), "$.k", "long").alias("k"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 20) || chr(10) || '...[' || (length(text) - 40) || ' omitted]...' || chr(10) || right(text, 20) ELSE text END AS cut FROM documents")
def truncated_texts(s, d):
    return table(s, d, "documents").select("doc_id", parse.truncate_middle(F.col("text"), 40).alias("cut"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN 'plain ' || c_name ELSE c_name END AS code FROM customer")
def code_blocks(s, d):
    k, name = F.col("c_custkey") % 3, F.col("c_name")
    text = F.when(k == 0, F.concat(F.lit("Run\n```python\n"), name, F.lit("\n```\nthen ```x```"))).when(k == 1, F.concat(F.lit("call `"), name, F.lit("` now"))).otherwise(F.concat(F.lit("plain "), name))
    return table(s, d, "customer").select("c_custkey", parse.code_block(text).alias("code"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'tag' WHEN c_custkey % 3 = 1 THEN 'text' END AS source FROM customer")
def final_answer_sources(s, d):
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, F.concat(F.lit("so <FINAL_ANSWER>"), F.col("c_name"), F.lit("</final_answer>"))).when(k == 1, F.col("c_name"))
    return table(s, d, "customer").select("c_custkey", parse.final_answer_source(text).alias("source"))


@query("""SELECT o_custkey AS sample, '{"sample":' || o_custkey || ',"files":[' || string_agg('{"file":"' || o_orderkey || '.csv","size":' || (o_orderkey % 90) || ',"sha256":"' || md5(o_orderkey::VARCHAR) || '"}', ',' ORDER BY o_orderkey::VARCHAR || '.csv') || ']}' AS manifest FROM orders GROUP BY o_custkey""")
def workspace_manifests(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("sample"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("file"), (F.col("o_orderkey") % 90).alias("size"), F.md5(F.col("o_orderkey").cast("string")).alias("sha256"))
    return files.workspace_manifest(o)
