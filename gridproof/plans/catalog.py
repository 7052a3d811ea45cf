"""All queries of the table-perturbation and evaluation operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code, ids, parse
from ..functions.rounding import fmt
from ..operators import canonical, files, gates, integrity, perturb, profile, reliability, robust, scoring, select, shape
from ..sources import grid
from . import decomposition, evaluation, packages, profiles, selection, structure  # noqa: F401
from . import fixtures as fx
from .fixtures import ratio, robust_sql, rounded, table, with_views
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401

def _clean(s, d):
    return canonical.canonical_clean(fx.clean_attempts(s, d))


EVENT_TYPES = ["click", "view", "purchase", "signup", "error"]
MODELS = ["m0", "m1", "m2"]


# Paired robustness.
@query(robust_sql("incorrect", ["attack_type"]))
def robust_summary_by_attack(s, d):
    return robust.robust_summary(fx.attacked(s, d), _clean(s, d), "incorrect", ["attack_type"])


@query(robust_sql("exclude", ["attack_type"]))
def robust_summary_by_attack_exclude(s, d):
    return robust.robust_summary(fx.attacked(s, d), _clean(s, d), "exclude", ["attack_type"])


@query(robust_sql("incorrect", []))
def robust_summary_overall(s, d):
    return robust.robust_summary(fx.attacked(s, d), _clean(s, d))


@query(robust_sql("exclude", []))
def robust_summary_overall_exclude(s, d):
    return robust.robust_summary(fx.attacked(s, d), _clean(s, d), "exclude")


@query(with_views("SELECT a.id, a.source_id, a.attack_type, CASE WHEN coalesce(a.source_id, '') = '' THEN 'missing_source_id' ELSE 'clean_source_not_found' END AS reason FROM attacked a LEFT JOIN clean c ON a.source_id = c.id WHERE c.id IS NULL", "attacked", "clean"))
def unmatched_records(s, d):
    return robust.unmatched(fx.attacked(s, d), _clean(s, d))


_ASR = f"SELECT model, attack_type, {rounded('attack_success_rate * 100', 6)} AS asr, support, attack_successes, {rounded('conditional_robust_accuracy * 100', 6)} AS cra, paired_records, unmatched_clean FROM ({robust_sql('incorrect', ['model', 'attack_type'])})"


@query(_ASR)
def operator_asr_long(s, d):
    return robust.operator_asr(fx.attacked(s, d), _clean(s, d), ["model", "attack_type"])


_CELL = "CASE WHEN asr IS NULL THEN 'N/A' ELSE format('{:.2f}', asr) || '% (n=' || support || ')' END"


@query(f"SELECT attack_type, {', '.join(f"coalesce(max({_CELL}) FILTER (WHERE model = '{m}'), '--') AS {m}" for m in MODELS)} FROM ({_ASR}) GROUP BY attack_type")
def operator_asr_matrix(s, d):
    return robust.asr_matrix(robust.operator_asr(fx.attacked(s, d), _clean(s, d), ["model", "attack_type"]), ["attack_type"], "model", MODELS)


@query(f"SELECT attack_type, model, regexp_extract(cell, '^[0-9.]+')::DOUBLE AS value, regexp_extract(cell, 'n=([0-9]+)', 1)::BIGINT AS support FROM (SELECT attack_type, model, {_CELL} AS cell FROM ({_ASR}))")
def matrix_cells_parsed(s, d):
    wide = robust.asr_matrix(robust.operator_asr(fx.attacked(s, d), _clean(s, d), ["model", "attack_type"]), ["attack_type"], "model", MODELS)
    long = shape.wide_to_long(wide, ["attack_type"], MODELS, "model", "cell")
    return long.select("attack_type", "model", F.regexp_extract("cell", "^[0-9.]+", 0).cast("double").alias("value"), F.regexp_extract("cell", "n=([0-9]+)", 1).cast("long").alias("support"))


@query("SELECT model, regexp_replace(format('{:.6f}', attack_success_rate), '\\.?0+$', '') AS asr, regexp_replace(format('{:.6f}', robustness_accuracy_drop), '\\.?0+$', '') AS rad FROM (" + robust_sql("incorrect", ["model"]) + ")")
def batch_asr_rad(s, d):
    return robust.batch_scores(fx.attacked(s, d), _clean(s, d), ["model"])


# Canonical attempts.
@query(with_views("SELECT id, correct, line, attempts, all_failed FROM clean", "clean"))
def canonical_clean_judgments(s, d):
    return _clean(s, d)


@query(with_views("""SELECT p.physical, p.summary, c.unique_ids, p.physical - p.summary - c.unique_ids AS collapsed, c.selected_successes, c.selected_failures
FROM (SELECT count(*) AS physical, count(*) FILTER (WHERE id = '__summary__') AS summary FROM clean_attempts) p,
(SELECT count(*) AS unique_ids, count(*) FILTER (WHERE NOT all_failed) AS selected_successes, count(*) FILTER (WHERE all_failed) AS selected_failures FROM clean) c""", "clean"))
def clean_canonicalization_stats(s, d):
    return canonical.canonicalization_stats(fx.clean_attempts(s, d))


_OK = "status = 'success' AND trim(answer) <> ''"
_CANON = f"""SELECT id, coalesce(max(line) FILTER (WHERE {_OK}), max(line)) AS line, CASE WHEN bool_or({_OK}) THEN 'success' ELSE arg_max(status, line) END AS status,
CASE WHEN bool_or({_OK}) THEN arg_max(answer, line) FILTER (WHERE {_OK}) ELSE arg_max(answer, line) END AS answer, min(line) AS first_line, count(*) AS attempts, bool_or({_OK}) AS is_success FROM predictions GROUP BY id"""


@query(with_views(_CANON, "predictions"))
def canonical_predictions(s, d):
    return canonical.canonical_predictions(fx.predictions(s, d))


@query(with_views(f"SELECT id, first_line, attempts FROM ({_CANON}) ORDER BY first_line, id LIMIT 25", "predictions"))
def limit_after_dedup(s, d):
    return canonical.limit_ids(canonical.canonical_predictions(fx.predictions(s, d)), 25).select("id", "first_line", "attempts")


@query(with_views(f"SELECT DISTINCT id FROM predictions WHERE id NOT IN (SELECT id FROM ({_CANON}) WHERE is_success)", "predictions"))
def resume_pending(s, d):
    p = fx.predictions(s, d)
    return canonical.pending(p.select("id").distinct(), canonical.canonical_predictions(p).filter("is_success"))


@query("SELECT doc_id, (SELECT 1) * l AS left_rows, r AS right_rows FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.n, 0) AS l, coalesce(b.n, 0) AS r FROM (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1) a FULL JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) b ON a.doc_id = b.doc_id) WHERE l <> 1 OR r <> 1")
def one_to_one_violations(s, d):
    return canonical.one_to_one_violations(table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id"), "doc_id")


@query("""SELECT id, arg_min(phase, phase * 1000000000 + line) AS phase, arg_min(line, phase * 1000000000 + line) AS line FROM
(SELECT user_id AS id, event_id % 2 AS phase, event_id AS line FROM events) GROUP BY id""")
def combined_union_distinct(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("id"), (F.col("event_id") % 2).alias("phase"), F.col("event_id").alias("line"))
    return canonical.first_wins(e, "id", ["phase", "line"], [])


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def question_label_join(s, d):
    return table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels"), "doc_id").select("doc_id", "lang", "quality")


# Refusals and correctness.
def _group_report(kind: str, name: str, group: str) -> str:
    m = lambda x, n: f"coalesce({rounded(f'({x}) / nullif({n}, 0)', 4)}, 0.0)"
    return f"""SELECT '{kind}' AS kind, {name} AS name, count(*) AS total, count(*) FILTER (WHERE ok) AS evaluable, count(*) FILTER (WHERE NOT ok) AS not_evaluable,
{m("sum(s)", "count(*)")} AS mean_score_all, {m("sum(s) FILTER (WHERE ok)", "count(*) FILTER (WHERE ok)")} AS mean_score_evaluable, {m("count(*) FILTER (WHERE s >= 1)", "count(*)")} AS success_rate_all,
{m("count(*) FILTER (WHERE ok AND s >= 1)", "count(*) FILTER (WHERE ok)")} AS success_rate_evaluable, {m("count(*) FILTER (WHERE s = 0.5)", "count(*)")} AS partial_rate, {m("count(*) FILTER (WHERE s = 0)", "count(*)")} AS failure_rate
FROM (SELECT *, coalesce(score, 0) AS s, judge_status = 'success' AS ok FROM refusals) {group}"""


@query(with_views(_group_report("total", "'all'", "") + " UNION ALL " + _group_report("attack_type", "attack_type", "GROUP BY attack_type") + " UNION ALL " + _group_report("model", "model", "GROUP BY model"), "refusals"))
def refusal_report(s, d):
    return reliability.refusal_report(fx.refusals(s, d))


@query(with_views(f"""SELECT model, count(*) AS total, count(*) FILTER (WHERE judge_status = 'success') AS evaluable, count(*) FILTER (WHERE score >= 1) AS correct_count, count(*) - count(*) FILTER (WHERE score >= 1) AS incorrect_count,
{ratio("count(*) FILTER (WHERE score >= 1)", "count(*)", 4)} AS accuracy_all, {ratio("count(*) FILTER (WHERE score >= 1 AND judge_status = 'success')", "count(*) FILTER (WHERE judge_status = 'success')", 4)} AS accuracy_evaluable FROM refusals GROUP BY model""", "refusals"))
def correctness_report(s, d):
    return reliability.correctness_report(fx.refusals(s, d), ["model"])


@query(with_views("SELECT coalesce(nullif(label, ''), 'unknown') AS label, count(*) AS n FROM refusals GROUP BY 1", "refusals"))
def label_counts(s, d):
    return reliability.label_counts(fx.refusals(s, d))


def _pct(x: str) -> str:
    return rounded(f"100.0::DOUBLE * ({x}) / count(*)", 2)


_REL = f"""SELECT model, attack_type, count(*) AS support, {_pct("count(*) FILTER (WHERE l = 'full_refusal')")} AS frr, {_pct("count(*) FILTER (WHERE l = 'partial_refusal')")} AS prr, {_pct("count(*) FILTER (WHERE l = 'no_refusal')")} AS nrr,
{_pct("count(*) FILTER (WHERE l = 'full_refusal') + 0.5::DOUBLE * count(*) FILTER (WHERE l = 'partial_refusal')")} AS mrs FROM (SELECT *, coalesce(nullif(label, ''), 'no_refusal') AS l FROM refusals) GROUP BY model, attack_type"""


def _rel(s, d):
    return reliability.operator_reliability(fx.refusals(s, d), ["model", "attack_type"])


@query(with_views(_REL, "refusals"))
def operator_reliability_long(s, d):
    return _rel(s, d)


def _matrix(metric: str) -> str:
    return with_views(f"SELECT attack_type, {', '.join(f"max({metric}) FILTER (WHERE model = '{m}') AS {m}" for m in MODELS)} FROM ({_REL}) GROUP BY attack_type", "refusals")


@query(_matrix("frr"))
def frr_matrix(s, d):
    return reliability.metric_matrix(_rel(s, d), "attack_type", "model", MODELS, "frr")


@query(_matrix("mrs"))
def mrs_matrix(s, d):
    return reliability.metric_matrix(_rel(s, d), "attack_type", "model", MODELS, "mrs")


EXCLUDED = ["QA_3", "QA_7", "QA_11", "QA_99"]
_IN = ", ".join(f"'{x}'" for x in EXCLUDED)


@query(with_views(f"SELECT judgment_id, upper(source_id) AS source, upper(source_id) IN ({_IN}) AS is_excluded FROM refusals", "refusals"))
def excluded_source_filter(s, d):
    return reliability.exclude_sources(fx.refusals(s, d), EXCLUDED).select("judgment_id", "source", "is_excluded")


@query(with_views(f"SELECT x AS source, count(r.source_id) AS rows FROM unnest([{_IN}]) t(x) LEFT JOIN refusals r ON upper(r.source_id) = x GROUP BY x", "refusals"))
def exclusion_report(s, d):
    return reliability.exclusion_report(fx.refusals(s, d), EXCLUDED)


@query(with_views("SELECT source_id, model, count(*) AS n FROM refusals GROUP BY 1, 2 HAVING count(*) > 1", "refusals"))
def duplicate_judgments(s, d):
    return reliability.duplicate_judgments(fx.refusals(s, d), ["source_id", "model"])


# Closed-form answers.
def _scores(s, d):
    return scoring.score_answers(fx.answers(s, d), fx.answer_key(s, d))


@query(with_views("SELECT id, label_id, line, status, n_fields > 0 AND n_fields = n_right AS correct, n_fields, n_right, wrong, missing FROM scored", "scored"))
def closed_form_scores(s, d):
    return _scores(s, d)


@query(with_views(f"""SELECT labels, matched, correct, {ratio("correct", "labels", 4)} AS question_accuracy, fields, right_fields, {ratio("right_fields", "fields", 4)} AS field_accuracy FROM (
SELECT count(*) AS labels, count(s.line) AS matched, count(*) FILTER (WHERE s.n_fields = s.n_right) AS correct, sum(k.n)::BIGINT AS fields, coalesce(sum(s.n_right), 0)::BIGINT AS right_fields
FROM (SELECT id, count(*) AS n FROM answer_key GROUP BY id) k LEFT JOIN scored s ON s.label_id = k.id)""", "scored"))
def closed_form_report(s, d):
    return scoring.dataset_report(_scores(s, d), fx.answer_key(s, d))


@query(with_views(f"SELECT concept, count(*) AS questions, count(*) FILTER (WHERE s.n_fields = s.n_right) AS correct, {ratio('count(*) FILTER (WHERE s.n_fields = s.n_right)', 'count(*)', 4)} AS accuracy FROM orders o, unnest([o_orderpriority, o_orderstatus]) t(concept) LEFT JOIN scored s ON s.label_id = o_orderkey::VARCHAR GROUP BY concept", "scored"))
def concept_accuracy(s, d):
    concepts = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.array("o_orderpriority", "o_orderstatus").alias("concepts"))
    return scoring.concept_accuracy(_scores(s, d), concepts)


@query("SELECT conv_id, turn, trim(text) AS answer, 'x' || conv_id AS tagged FROM conversations WHERE role = 'assistant'")
def final_answer_extraction(s, d):
    c = table(s, d, "conversations").filter("role = 'assistant'")
    return c.select("conv_id", "turn", parse.final_answer(F.col("text")).alias("answer"), parse.final_answer(F.concat(F.lit("so <FINAL_answer> x"), F.col("conv_id").cast("string"), F.lit(" </final_answer> done"))).alias("tagged"))


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS rounds, count(*) FILTER (WHERE role = 'tool') AS tool_calls FROM conversations GROUP BY conv_id")
def assistant_rounds(s, d):
    return select.assistant_rounds(table(s, d, "conversations"))


# Perturbations that keep the answer.
def _customer(s, d):
    return table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("SELECT *, row_number() OVER (ORDER BY md5('rows|' || c_custkey), c_custkey) AS row_no FROM (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer)")
def row_order_shuffle(s, d):
    return perturb.row_order_shuffle(_customer(s, d), ["c_custkey"])


@query(f"""WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r, row_number() OVER (ORDER BY md5('rows|' || c_custkey), c_custkey) AS n FROM customer)
SELECT count(*) AS rows, count(*) FILTER (WHERE r <> n) AS moved, 0::BIGINT AS multiset_issues, {ratio("count(*) FILTER (WHERE r <> n)", "count(*)")} AS moved_share, {ratio("count(*) FILTER (WHERE r <> n)", "count(*)")} >= 0.8 AS passed FROM a""")
def row_order_shuffle_check(s, d):
    t = _customer(s, d)
    return integrity.row_shuffle_check(grid.number_rows(t, ["c_custkey"]), perturb.row_order_shuffle(t, ["c_custkey"]), t.columns)


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def column_order_shuffle(s, d):
    t = _customer(s, d)
    return t.select(*perturb.column_order_shuffle(t))


@query("SELECT 4::BIGINT AS columns, 4::BIGINT AS moved, true AS passed")
def column_order_shuffle_check(s, d):
    t = _customer(s, d)
    return s.createDataFrame([integrity.column_shuffle_check(t.columns, perturb.column_order_shuffle(t))], "columns long, moved long, passed boolean")


@query("SELECT c_custkey, c_name AS customer_label, c_nationkey, c_mktsegment AS market_group FROM customer")
def header_synonym_substitution(s, d):
    return perturb.header_synonyms(_customer(s, d), {"c_name": "customer_label", "c_mktsegment": "market_group"})


@query("SELECT 0::BIGINT AS changed")
def header_synonym_substitution_check(s, d):
    t = _customer(s, d)
    after = perturb.header_synonyms(t, {"c_name": "customer_label"}).withColumnRenamed("customer_label", "c_name")
    return integrity.originals_unchanged(t, after, t.columns)


def _distracted(s, d):
    t = table(s, d, "part").select("p_partkey", "p_retailprice", "p_size")
    return perturb.distractor_column(t, "p_retailprice", "p_listprice", F.col("p_retailprice") + F.col("p_size") / 10.0)


@query("SELECT p_partkey, p_retailprice, p_retailprice + p_size / 10.0::DOUBLE AS p_listprice, p_size FROM part")
def semantic_distractor_column(s, d):
    return _distracted(s, d)


@query(f"SELECT count(p_retailprice) AS target_values, 1.0::DOUBLE AS coverage, {ratio('count(*) FILTER (WHERE p_size <> 0)', 'count(*)')} AS different, {ratio('count(*) FILTER (WHERE p_size <> 0)', 'count(*)')} >= 0.3 AS passed FROM part")
def semantic_distractor_column_check(s, d):
    return integrity.distractor_check(_distracted(s, d), "p_retailprice", "p_listprice")


def _orders(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, format('{:,.2f}', o_totalprice) AS o_totalprice, strftime(o_orderdate, '%Y/%m/%d') AS o_orderdate FROM orders")
def equivalent_value_reencoding(s, d):
    return perturb.reencode(_orders(s, d), {"o_totalprice": "thousands", "o_orderdate": "date"})


@query("SELECT 'o_totalprice' AS \"column\", count(*) AS cells, count(*) FILTER (WHERE o_totalprice::VARCHAR <> format('{:,.2f}', o_totalprice)) AS changed, 0::BIGINT AS inequivalent, 0::BIGINT AS missing_changed, true AS passed FROM orders")
def equivalent_value_reencoding_check(s, d):
    t = _orders(s, d)
    return integrity.reencoding_check(t, perturb.reencode(t, {"o_totalprice": "thousands"}), "o_orderkey", ["o_totalprice"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 100.0::DOUBLE AS o_totalprice_cents, o_orderdate FROM orders")
def unit_scale_conversion(s, d):
    return perturb.unit_scale(_orders(s, d), "o_totalprice", 100.0, "o_totalprice_cents")


@query("SELECT count(*) AS values, 100.0::DOUBLE AS least_ratio, 100.0::DOUBLE AS most_ratio, 0::BIGINT AS zero_changed, true AS passed FROM orders")
def unit_scale_conversion_check(s, d):
    t = _orders(s, d)
    return integrity.unit_check(t, perturb.unit_scale(t, "o_totalprice", 100.0, "o_totalprice_cents"), "o_orderkey", "o_totalprice", "o_totalprice_cents")


_FIELDS = ["c_name", "c_nationkey", "c_mktsegment"]
_LONG = " UNION ALL ".join(f"SELECT c_custkey, '{c}' AS field, {c}::VARCHAR AS value FROM customer" for c in _FIELDS)


@query(_LONG)
def wide_to_long(s, d):
    return shape.wide_to_long(_customer(s, d), ["c_custkey"], _FIELDS)


@query("SELECT c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment FROM customer")
def long_to_wide(s, d):
    return shape.long_to_wide(shape.wide_to_long(_customer(s, d), ["c_custkey"], _FIELDS), ["c_custkey"], _FIELDS)


@query("SELECT unnest(['cardinality_mismatch', 'repeated_key', 'reshape_inverse_mismatch']) AS issue, 0::BIGINT AS n")
def reshape_inverse_check(s, d):
    t = _customer(s, d)
    return shape.reshape_check(t, shape.wide_to_long(t, ["c_custkey"], _FIELDS), ["c_custkey"], _FIELDS)


_PARTS = {"names": ["c_name"], "places": ["c_nationkey", "c_mktsegment"]}


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def relational_decomposition(s, d):
    return shape.rejoin(shape.decompose(_customer(s, d), ["c_custkey"], _PARTS), ["c_custkey"])


@query("SELECT unnest(['unsafe_join_cardinality:names', 'unsafe_join_cardinality:places', 'orphan_join_record:places', 'relational_inverse_mismatch']) AS issue, 0::BIGINT AS n")
def rejoin_check(s, d):
    t = _customer(s, d)
    return shape.rejoin_check(t, shape.decompose(t, ["c_custkey"], _PARTS), ["c_custkey"])


def _decoyed(s, d):
    return perturb.decoy_features(_orders(s, d).drop("o_orderdate"), "o_orderkey", "o_totalprice", "o_orderstatus")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, floor(o_totalprice * 110 + 0.5) / 100 AS o_totalprice_forecast, floor(o_totalprice / 1000)::BIGINT AS o_totalprice_band,
 o_totalprice > avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS o_totalprice_above_mean FROM orders""")
def decoy_feature_pack(s, d):
    return _decoyed(s, d)


@query("SELECT 0::BIGINT AS changed")
def decoy_originals_unchanged(s, d):
    before = _orders(s, d).drop("o_orderdate")
    return integrity.originals_unchanged(before, _decoyed(s, d), before.columns)


@query("SELECT (SELECT 2 * count(*) FROM orders WHERE o_orderkey % 5 = 0) AS changed")
def damaged_originals_found(s, d):
    before = _orders(s, d).drop("o_orderdate")
    damaged = _decoyed(s, d).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1000000).otherwise(F.col("o_totalprice")))
    return integrity.originals_unchanged(before, damaged, before.columns)


@query("SELECT c AS \"column\", (SELECT count(*) FROM orders) AS filled, 1.0::DOUBLE AS coverage, true AS passed FROM unnest(['o_totalprice_forecast', 'o_totalprice_band', 'o_totalprice_above_mean']) t(c)")
def decoy_feature_pack_check(s, d):
    return integrity.coverage_check(_decoyed(s, d), ["o_totalprice_forecast", "o_totalprice_band", "o_totalprice_above_mean"])


@query("""SELECT c_custkey, c_name, c_nationkey, c_mktsegment, 'observation' AS record_type FROM customer UNION ALL
SELECT (SELECT max(c_custkey) FROM customer) + 1 + row_number() OVER (ORDER BY c_custkey), c_name, c_nationkey, c_mktsegment, 'simulated' FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)""")
def non_observation_rows(s, d):
    return perturb.non_observation_rows(_customer(s, d), "c_custkey", 5)


@query("SELECT count(*) AS observed, 5::BIGINT AS added, 0::BIGINT AS changed, greatest(5, ceil(count(*) / 10))::BIGINT AS allowed, true AS passed FROM customer")
def non_observation_rows_check(s, d):
    t = _customer(s, d)
    return integrity.non_observation_check(t, perturb.non_observation_rows(t, "c_custkey", 5))


@query("SELECT c_mktsegment AS sheet, count(*) AS rows, count(DISTINCT c_custkey) AS keys FROM customer GROUP BY 1")
def cross_sheet_split(s, d):
    return perturb.cross_sheet_split(_customer(s, d), "c_mktsegment").groupBy("sheet").agg(F.count("*").alias("rows"), F.count_distinct("c_custkey").alias("keys"))


@query("SELECT 0::BIGINT AS changed")
def cross_sheet_split_check(s, d):
    t = _customer(s, d)
    return integrity.originals_unchanged(t, perturb.cross_sheet_split(t, "c_mktsegment"), t.columns)


def _grid(s, d):
    return grid.from_table(table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "supplier", ["s_suppkey"])


_SUPPLIER = """SELECT 1 AS "row", unnest([1, 2, 3]) AS col, unnest(['s_suppkey', 's_name', 's_nationkey']) AS value UNION ALL
SELECT (1 + row_number() OVER (ORDER BY s_suppkey))::INTEGER, 1, s_suppkey::VARCHAR FROM supplier UNION ALL SELECT (1 + row_number() OVER (ORDER BY s_suppkey))::INTEGER, 2, s_name FROM supplier UNION ALL
SELECT (1 + row_number() OVER (ORDER BY s_suppkey))::INTEGER, 3, s_nationkey::VARCHAR FROM supplier"""


@query(_SUPPLIER)
def grid_cells(s, d):
    return _grid(s, d).select("row", "col", "value")


@query(f"""SELECT "row" + 1 AS "row", col, value FROM ({_SUPPLIER}) WHERE "row" > 1 UNION ALL SELECT 1, unnest([1, 2, 3]), 's' UNION ALL SELECT 2, unnest([1, 2, 3]), unnest(['suppkey', 'name', 'nationkey'])""")
def hierarchical_header(s, d):
    return perturb.relayout(_grid(s, d), ["s_suppkey", "s_name", "s_nationkey"]).select("row", "col", "value")


@query("SELECT 'row_order' AS \"check\", true AS passed UNION ALL SELECT 'unit_scale', true UNION ALL SELECT 'distractor', true UNION ALL SELECT 'non_observation', true")
def integrity_report(s, d):
    return integrity.report({"row_order": row_order_shuffle_check(s, d), "unit_scale": unit_scale_conversion_check(s, d), "distractor": semantic_distractor_column_check(s, d), "non_observation": non_observation_rows_check(s, d)})


@query("""SELECT 'part-' || p_size AS file, CASE WHEN p_size % 4 = 0 THEN 'removed' WHEN p_size % 4 = 1 THEN 'changed' ELSE 'unchanged' END AS state FROM (SELECT DISTINCT p_size FROM part)
UNION ALL SELECT 'new-' || p_size, 'added' FROM (SELECT DISTINCT p_size FROM part) WHERE p_size % 7 = 0""")
def file_package_diff(s, d):
    sizes = table(s, d, "part").select("p_size").distinct()
    before = sizes.select(F.concat(F.lit("part-"), F.col("p_size").cast("string")).alias("file"), F.sha2(F.col("p_size").cast("string"), 256).alias("sha256"))
    kept = sizes.filter("p_size % 4 <> 0").select(F.concat(F.lit("part-"), F.col("p_size").cast("string")).alias("file"), F.sha2(F.when(F.col("p_size") % 4 == 1, F.lit("x")).otherwise(F.col("p_size").cast("string")), 256).alias("sha256"))
    new = sizes.filter("p_size % 7 = 0").select(F.concat(F.lit("new-"), F.col("p_size").cast("string")).alias("file"), F.lit("y").alias("sha256"))
    return integrity.package_diff(before, kept.unionByName(new))


@query("SELECT sum((p_retailprice * p_size)::DECIMAL(18,4))::VARCHAR AS worth, count(*) AS n, sum(p_size)::BIGINT AS total FROM part")
def answer_invariance(s, d):
    t = table(s, d, "part").select("p_partkey", "p_retailprice", "p_size")
    return perturb.row_order_shuffle(t, ["p_partkey"]).agg(F.sum((F.col("p_retailprice") * F.col("p_size")).cast("decimal(18,4)")).cast("string").alias("worth"), F.count("*").alias("n"), F.sum("p_size").alias("total"))


# Perturbations that take the answer away.
@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def field_missing(s, d):
    return perturb.field_missing(_orders(s, d), "o_totalprice")


@query("SELECT 'o_custkey' AS candidate, false AS is_bijection UNION ALL SELECT 'o_orderstatus', false")
def field_missing_check(s, d):
    return integrity.equivalent_fields(_orders(s, d), "o_totalprice", ["o_custkey", "o_orderstatus"])


_NEEDED = "o_orderkey % 10 = 3"


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN NOT ({_NEEDED}) THEN o_totalprice END AS o_totalprice, o_orderdate FROM orders")
def data_missing(s, d):
    return perturb.data_missing(_orders(s, d), "o_totalprice", F.expr(_NEEDED))


@query(f"SELECT count(*) FILTER (WHERE {_NEEDED}) AS nulled, 0::BIGINT AS filled, 0::BIGINT AS altered, 0::BIGINT AS others_changed, true AS passed FROM orders")
def data_missing_check(s, d):
    t = _orders(s, d)
    return integrity.missing_values_check(t, perturb.data_missing(t, "o_totalprice", F.expr(_NEEDED)), "o_orderkey", "o_totalprice")


@query(f"SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice + 50 FROM orders WHERE {_NEEDED}")
def evidence_conflict(s, d):
    return perturb.evidence_conflict(_orders(s, d).select("o_orderkey", "o_totalprice"), "o_totalprice", F.expr(_NEEDED), F.col("o_totalprice") + 50)


@query(f"SELECT o_orderkey, 2::BIGINT AS n_values FROM orders WHERE {_NEEDED}")
def evidence_conflict_check(s, d):
    t = _orders(s, d).select("o_orderkey", "o_totalprice")
    return integrity.conflicts(perturb.evidence_conflict(t, "o_totalprice", F.expr(_NEEDED), F.col("o_totalprice") + 50), "o_orderkey", "o_totalprice")


@query("SELECT p_partkey::VARCHAR AS file, CASE WHEN p_size % 5 = 0 THEN 'removed' ELSE 'unchanged' END AS state FROM part")
def file_missing(s, d):
    inventory = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("file"), F.sha2("p_name", 256).alias("sha256"), "p_size")
    return integrity.package_diff(inventory, inventory.filter("p_size % 5 <> 0"))


@query("""WITH numbered AS (SELECT *, 1 + row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier)
SELECT 1::INTEGER AS "row", unnest([1, 2, 3])::INTEGER AS col, unnest(['s_suppkey', 's_nationkey', 's_nationkey']) AS value, unnest([false, false, true]) AS repeated
UNION ALL SELECT r::INTEGER, unnest([1, 2, 3])::INTEGER, unnest([s_suppkey::VARCHAR, s_name, s_nationkey::VARCHAR]), NULL FROM numbered""")
def header_conflict(s, d):
    cells = grid.from_table(table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "supplier", ["s_suppkey"])
    conflict = perturb.conflicting_header(cells, "s_name", "s_nationkey")
    names = profile.column_names(conflict.filter("row = 1")).select("col", "repeated")
    return conflict.join(F.broadcast(names), "col").select("row", "col", "value", F.when(F.col("row") == 1, F.col("repeated")).alias("repeated"))


@query("""WITH c AS (SELECT o_orderstatus, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS v FROM orders), g AS (SELECT o_orderstatus, count(*) AS n, count(v) AS n_known FROM c GROUP BY 1)
SELECT (SELECT count(*) FROM c) AS step1_rows, (SELECT count(*) FROM g) AS step2_groups, (SELECT count(*) FROM g WHERE n = n_known) AS step3_ranked""")
def deep_analysis_missing(s, d):
    one, two, three = perturb.deep_analysis_missing(_orders(s, d), "o_orderstatus", "o_totalprice", F.col("o_orderstatus") == "F")
    counts = [x.agg(F.count("*").alias(n)) for x, n in ((one, "step1_rows"), (two, "step2_groups"), (three, "step3_ranked"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


@query(f"""SELECT "row", col, value FROM ({_SUPPLIER}) WHERE "row" > 1 UNION ALL SELECT 1, unnest([1, 2, 3]), unnest(['suppkey', 'name', 'nationkey'])""")
def structural_context_missing(s, d):
    return perturb.structural_context_missing(perturb.relayout(_grid(s, d), ["s_suppkey", "s_name", "s_nationkey"])).select("row", "col", "value")


# Profiles and selection.
@query("SELECT 'supplier' AS file, 1 AS header_row, 4 * 3 + 1.5::DOUBLE * 3 + 3 AS score")
def profile_header_row(s, d):
    return profile.header_row(_grid(s, d)).select("file", "header_row", "score")


@query("SELECT unnest([1, 2, 3]) AS col, unnest(['number', 'text', 'number']) AS dtype, 8::BIGINT AS nonempty")
def profile_dtypes(s, d):
    return profile.column_types(_grid(s, d)).select("col", "dtype", "nonempty")


@query("SELECT unnest([1, 2, 3]) AS col, unnest(['s_suppkey', 's_name', 's_nationkey']) AS name, false AS repeated")
def profile_columns(s, d):
    return profile.column_names(_grid(s, d).filter("row = 1")).select("col", "name", "repeated")


@query("SELECT 'supplier' AS file, (count(*) + 1)::INTEGER AS rows, 3 AS cols, (count(*) + 1) * 3 AS cells, 0::BIGINT AS formulas, false AS dimension_suspect FROM supplier")
def profile_sheets(s, d):
    return profile.sheet_profile(_grid(s, d)).drop("sheet")


@query("SELECT 'supplier' AS file, false AS looks_multirow")
def profile_multirow_header(s, d):
    return profile.multirow_header(_grid(s, d)).drop("sheet")


@query("SELECT o_custkey AS package, count(*) AS file_count, count(*) FILTER (WHERE o_orderstatus <> 'P') AS existing_file_count, 'delimited' AS kinds, count(*) = count(*) FILTER (WHERE o_orderstatus <> 'P') AS all_files_exist FROM orders GROUP BY 1")
def profile_packages(s, d):
    files = table(s, d, "orders").select(F.col("o_custkey").alias("package"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".CSV")).alias("file"), (F.col("o_orderstatus") != "P").alias("found"))
    return profile.package_profile(files)


@query(with_views("SELECT sample, operator, ordinal, confidence, priority FROM best", "best"))
def topk_per_sample(s, d):
    return select.best_candidates(fx.candidates(s, d))


@query(with_views("""SELECT sample, operator, p AS position, CASE WHEN p <= 2 THEN 'selected' ELSE 'skipped' END AS status, CASE WHEN p > 2 THEN 'max_attacks_limit' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY priority, confidence DESC, operator) AS p FROM best)""", "best"))
def select_attacks(s, d):
    return select.select_attacks(fx.candidates(s, d), 2)


@query("SELECT doc_id AS id, quality = 1 AND toxic = 0 AS accepted, CASE WHEN quality <> 1 THEN 'valid' WHEN toxic <> 0 THEN 'fabricated' END AS failed_field FROM labels")
def acceptance_gate(s, d):
    rows = table(s, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("valid"), (F.col("toxic") == 1).alias("fabricated"))
    return select.acceptance_gate(rows, ["valid"], ["fabricated"])


@query("SELECT count(*) AS loaded, count(*) FILTER (WHERE done) AS completed, count(*) FILTER (WHERE NOT done) AS remaining FROM (SELECT o_custkey, bool_and(o_orderstatus IN ('F', 'O')) AS done FROM orders GROUP BY 1)")
def resume_summary(s, d):
    return select.resume_summary(table(s, d, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderstatus").alias("status")), ["F", "O"])


@query("SELECT o_custkey AS sample, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def status_counts(s, d):
    return select.status_counts(table(s, d, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderstatus").alias("status")))


# Scalar functions.
@query("""SELECT o_orderkey, true AS same_number, true AS same_percent, true AS same_date, false AS other_date, 'number' AS kind FROM orders""")
def value_equivalence(s, d):
    o = table(s, d, "orders")
    price = fmt(F.col("o_totalprice"), "0.00")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    same = parse.values_equivalent
    return o.select(
        "o_orderkey", same(price, fmt(F.col("o_totalprice"), "#,##0.00")).alias("same_number"), same(F.lit("50%"), F.lit("0.5")).alias("same_percent"),
        same(day, F.date_format("o_orderdate", "yyyy/M/d")).alias("same_date"), same(day, F.date_format("o_orderdate", "MM/dd/yyyy")).alias("other_date"), parse.family(price).alias("kind"),
    )


@query("SELECT c_custkey, 'DA_' || c_custkey || '__row_order_shuffle__001' AS attack_id, [c_name, 'b,c.csv'] AS files, c_name || chr(10) || chr(10) || 'Required output format: @x[..]' AS question FROM customer")
def text_functions(s, d):
    c = table(s, d, "customer")
    files = parse.split_names(F.concat(F.col("c_name"), F.lit(' ;"b,c.csv"\n'), F.col("c_name"), F.lit("；")))
    return c.select("c_custkey", parse.attack_id(F.concat(F.lit("DA_"), F.col("c_custkey").cast("string")), F.lit("row_order_shuffle"), F.lit(1)).alias("attack_id"), files.alias("files"), parse.question_text(F.col("c_name"), F.lit(" "), F.lit("@x[..]")).alias("question"))


@query("SELECT event_id, CASE WHEN x <= 0.25 THEN 0.0 WHEN x <= 0.75 THEN 0.5 WHEN x > 0.75 THEN 1.0 END::DOUBLE AS score, CASE WHEN x <= 0.25 THEN 'no_refusal' WHEN x <= 0.75 THEN 'partial_refusal' WHEN x > 0.75 THEN 'full_refusal' END AS label FROM (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 0.25 WHEN 1 THEN 0.75 WHEN 2 THEN NULL ELSE value / 100 END::DOUBLE AS x FROM events)")
def score_labels(s, d):
    k = F.col("event_id") % 9  # ties and nulls among them
    x = parse.nearest_score(F.when(k == 0, F.lit(0.25)).when(k == 1, F.lit(0.75)).when(k != 2, F.col("value") / 100))
    return table(s, d, "events").select("event_id", x.alias("score"), parse.refusal_label(x).alias("label"))


# Identifiers, files and gates.
@query("SELECT judgment_id, judgment_id AS id, 'DA_' || judgment_id AS whole_id, coalesce(nullif(label, ''), 'unknown') AS label, 'a_b_c.csv' AS safe, 'm_x' AS model, 'p::' || judgment_id || '::1' AS key FROM (" + with_views("SELECT * FROM refusals", "refusals") + ")")
def identifiers(s, d):
    x = fx.refusals(s, d)
    return x.select(
        "judgment_id", ids.clean_id(F.col("judgment_id")).alias("id"), ids.clean_id(F.col("judgment_id").cast("long")).alias("whole_id"), ids.or_default(F.col("label")).alias("label"), ids.safe_name(F.lit(' a:b*/c.csv ')).alias("safe"),
        ids.model_name(F.lit("/x/m_x_judgments.jsonl"), {"other": "o"}).alias("model"), ids.judgment_key(F.lit("p"), F.col("judgment_id"), F.lit(1)).alias("key"),
    )


@query("""SELECT o_custkey AS sample, o_orderkey::VARCHAR AS reference, CASE WHEN o_orderstatus = 'F' THEN o_orderkey::VARCHAR WHEN o_orderstatus = 'O' THEN o_custkey || '/' || o_orderkey ELSE o_orderkey::VARCHAR END AS path, o_orderstatus IN ('F', 'O') AS found FROM orders""")
def file_resolution(s, d):
    o = table(s, d, "orders")
    refs = o.select(F.col("o_custkey").cast("string").alias("sample"), F.col("o_orderkey").cast("string").alias("reference"))
    there = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("path")).unionByName(o.filter("o_orderstatus IN ('F', 'O')").select(F.concat_ws("/", "o_custkey", "o_orderkey").alias("path")))
    return files.resolve_files(refs, there).withColumn("sample", F.col("sample").cast("long"))


_CATALOG = "(VALUES ('a', '.csv', 1), ('b', '.xlsx', 1), ('c', '.csv', 4)) t(operator, takes, least_files)"


@query(f"""SELECT sample, operator, takes = suffix AND n >= least_files AS eligible, CASE WHEN takes <> suffix THEN 'unsupported_format' WHEN n < least_files THEN 'too_few_files' END AS reason
FROM (SELECT o_custkey AS sample, CASE WHEN o_custkey % 2 = 0 THEN '.csv' ELSE '.xlsx' END AS suffix, count(*) AS n FROM orders GROUP BY ALL), {_CATALOG}""")
def operator_eligibility(s, d):
    packages = table(s, d, "orders").groupBy(F.col("o_custkey").alias("sample")).agg(F.count("*").alias("file_count")).withColumn("suffixes", F.array(F.when(F.col("sample") % 2 == 0, ".csv").otherwise(".xlsx")))
    cat = s.createDataFrame([("a", [".csv"], 1), ("b", [".xlsx"], 1), ("c", [".csv"], 4)], "operator string, suffixes array<string>, least_files int")
    return files.eligible_operators(packages, cat)


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 4 = 0 THEN '{}' ELSE '{\"operator\":\"' || o_orderstatus || '\"}' END AS construction FROM orders")
def public_projection(s, d):
    made = F.struct(F.col("o_orderstatus").alias("operator"), F.array(F.lit("x")).alias("construct_history"), F.lit(2).alias("validation_attempts"))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 4 != 0, made).alias("construction"))
    return files.public_records(o).withColumn("construction", F.to_json("construction"))


@query("SELECT c_custkey, c_nationkey::VARCHAR AS file_name, 'table_not_found' AS reason FROM customer WHERE c_nationkey >= 10")
def missing_table_report(s, d):
    q = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("file_name"))
    return files.missing_tables(q, table(s, d, "nation").filter("n_nationkey < 10").select(F.col("n_nationkey").cast("string").alias("file")))


@query("SELECT o_orderstatus, count(*) AS n, format('{:.2f}', sum(round(o_totalprice, 2)::DECIMAL(18,2))) AS total, format('{:.4f}', sum(round(o_totalprice, 2)::DECIMAL(18,2))::DOUBLE / count(*)) AS mean, min(round(o_totalprice, 2)) AS least, max(round(o_totalprice, 2)) AS most FROM orders GROUP BY 1")
def computed_aggregates(s, d):
    o = table(s, d, "orders").select("o_orderstatus", fmt(F.col("o_totalprice"), "#,##0.00").alias("v"))
    return files.computed_aggregates(o, ["o_orderstatus"], "v").withColumns({"total": fmt(F.col("total"), "0.00"), "mean": fmt(F.col("mean"), "0.0000")})


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'requests' WHEN event_id % 3 = 1 THEN 'c:\\' END AS fragment FROM events")
def code_safety_fragments(s, d):
    k = F.col("event_id") % 3
    return table(s, d, "events").select("event_id", code.banned_fragment(F.when(k == 0, "import Requests").when(k == 1, "open('C:\\x')").otherwise("x = 1")).alias("fragment"))


@query("""SELECT user_id AS sample, event_type AS operator, 'duplicate_operator' AS issue FROM events WHERE event_type <> 'view' GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT DISTINCT user_id, 'view', 'unknown_operator' FROM events WHERE event_type = 'view'
UNION ALL SELECT sample, operator, 'omitted_operator' FROM (SELECT DISTINCT user_id AS sample FROM events), (SELECT DISTINCT event_type AS operator FROM events WHERE event_type <> 'view')
WHERE (sample, operator) NOT IN (SELECT (user_id, event_type) FROM events)""")
def selection_closure(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("operator"))
    return gates.selection_closure(e, e.filter("operator <> 'view'").select("operator").distinct())


@query(with_views("SELECT sample, operator, ordinal, ordinal % 2 = 0 AND confidence / 10 >= 0.7 AS eligible, CASE WHEN ordinal % 2 = 0 AND confidence / 10 < 0.7 THEN 'below_confidence_threshold' END AS reason FROM candidates", "candidates"))
def confidence_gate(s, d):
    c = fx.candidates(s, d).select("sample", "operator", "ordinal", (F.col("ordinal") % 2 == 0).alias("eligible"), (F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)) / 10).cast("string").alias("confidence"), F.lit(None).cast("string").alias("reason"))
    return gates.confidence_gate(c).drop("confidence")


@query("""SELECT doc_id, failed IS NULL AS accepted, failed, CASE WHEN failed IS NULL THEN 'accepted' WHEN failed IN ('evidence_missing', 'reference_mismatch') THEN 'repair' ELSE 'reject' END AS retry FROM (
SELECT doc_id, CASE WHEN quality <> 1 THEN 'verdict' WHEN toxic = 1 THEN 'evidence_missing' WHEN doc_id % 5 = 0 THEN 'reference_mismatch' WHEN doc_id % 7 = 0 THEN 'audit_failed' END AS failed FROM labels)""")
def judge_gate(s, d):
    x, empty = table(s, d, "labels"), F.array().cast("array<string>")
    rows = x.select(
        "doc_id", F.when(F.col("quality") == 1, "valid").otherwise("invalid").alias("verdict"), F.col("doc_id").alias("answer"), F.when(F.col("toxic") == 1, empty).otherwise(F.array(F.lit("e"))).alias("evidence"),
        F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("d"))).otherwise(empty).alias("differences"), F.array(F.lit(True), F.col("doc_id") % 7 != 0).alias("audits"), F.lit(2).alias("declared"),
    )
    out = gates.judge_gate(rows)
    return out.select("doc_id", "accepted", "failed", gates.retry_class(F.when(F.col("failed") == "evidence_missing", "evidence_lost").when(F.col("failed") == "reference_mismatch", "answer_changed").otherwise(F.col("failed"))).alias("retry"))


@query("""SELECT doc_id, failed IS NULL AS accepted, failed FROM (SELECT doc_id, CASE WHEN quality <> 1 THEN 'can_answer' WHEN toxic = 1 THEN 'fabricated_answer' WHEN doc_id % 4 = 0 AND doc_id % 3 <> 0 THEN 'hardness_valid' END AS failed FROM labels)""")
def refusal_gate(s, d):
    rows = table(s, d, "labels").select(
        "doc_id", F.lit("valid").alias("verdict"), (F.col("quality") != 1).alias("can_answer"), F.lit(True).alias("should_refuse"), F.when(F.col("toxic") == 1, True).alias("fabricated_answer"),
        F.when(F.col("doc_id") % 4 == 0, "hard").otherwise("easy").alias("level"), (F.col("doc_id") % 3 == 0).alias("hardness_valid"), F.array(F.lit("a")).alias("files_before"), F.array(F.lit("b")).alias("files_after"),
    )
    return gates.refusal_gate(rows).select("doc_id", "accepted", "failed")


@query("""SELECT o_custkey AS sample, o_orderkey AS operator, CASE WHEN o_orderkey % 5 = 0 THEN 'accepted' WHEN o_orderkey % 7 = 0 THEN 'rejected' WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'eligible' WHEN o_orderstatus = 'F' THEN 'fatal_error' ELSE 'pending' END AS status FROM orders""")
def recover_states(s, d):
    log = table(s, d, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("operator"), F.when(F.col("o_orderstatus") == "F", "fatal_error").otherwise("pending").alias("status"), (F.col("o_orderkey") % 2 == 0).alias("selected"))
    return gates.recover(log, log.filter("operator % 5 = 0"), log.filter("operator % 7 = 0"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, unnest(range(l_linenumber, l_linenumber + 1 + l_partkey % 3))::BIGINT AS \"row\" FROM lineitem")
def declared_row_ranges(s, d):
    x = table(s, d, "lineitem")
    first = F.col("l_linenumber").cast("long")
    rows = parse.declared_rows(first, F.when(F.col("l_partkey") % 3 > 0, first + F.col("l_partkey") % 3))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(rows).alias("row"))


@query("SELECT event_id, CASE WHEN event_id % 5 > 1 THEN value END AS number, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events")
def json_safe_values(s, d):
    e = table(s, d, "events")
    bad = F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 5 == 1, float("-inf")).otherwise(F.col("value"))
    return e.select("event_id", parse.json_number(bad).alias("number"), parse.json_time(F.col("ts")).alias("at"))


@query("SELECT DISTINCT event_type AS operator, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS catalog_index FROM events")
def operator_catalog_order(s, d):
    return gates.catalog_order(table(s, d, "events").select(F.col("event_type").alias("operator")).distinct(), "operator", ["view", "click"])


@query("SELECT doc_id AS id, 1 AS fields, 1200 AS longest FROM labels")
def repair_feedback(s, d):
    rows = table(s, d, "labels").select(F.col("doc_id").alias("id"), F.create_map(F.lit("joins"), F.lit("a"), F.lit("secret"), F.lit("b")).alias("evidence"), F.repeat(F.lit("x"), F.lit(2000)).alias("reason"))
    return gates.repair_feedback(rows).select("id", F.size("evidence").alias("fields"), F.length("reason").alias("longest"))
