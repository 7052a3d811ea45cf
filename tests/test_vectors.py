"""Small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from gridproof.functions import parse
from gridproof.functions.rounding import plain, q
from gridproof.operators import canonical, integrity, perturb, profile, reliability, robust, scoring, select, shape
from gridproof.sources import grid


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def test_last_valid_attempt_wins(spark):
    log = [("a", 1, "run_failed", ""), ("a", 2, "success", "x"), ("b", 3, "success", "x"), ("b", 4, "run_failed", ""), ("c", 5, "success", "x"), ("c", 6, "success", "y"), ("d", 7, "run_failed", ""), ("d", 8, "run_failed", None)]
    rows = canonical.canonical_predictions(spark.createDataFrame(log, "id string, line long, status string, answer string"))
    assert {r.id: (r.line, r.is_success) for r in rows.collect()} == {"a": (2, True), "b": (3, True), "c": (6, True), "d": (8, False)}
    assert [r.id for r in canonical.limit_ids(rows, 2).collect()] == ["a", "b"]


def test_clean_log(spark):
    log = [("a", 1, "success", False), ("a", 2, "success", True), ("a", 3, "judge_error", None), ("b", 4, "judge_error", None), ("b", 5, "skipped", None), ("__summary__", 6, None, None)]
    df = spark.createDataFrame(log, "id string, line long, judge_status string, is_correct boolean")
    assert {r.id: r.correct for r in canonical.canonical_clean(df).collect()} == {"a": True, "b": False}
    assert tuple(canonical.canonicalization_stats(df).first()) == (6, 1, 2, 3, 1, 1)


def test_outcomes_by_score(spark):
    kind = "id string, line long, judge_status string, is_correct boolean, score double"
    log = [("DA_1", 1, None, None, 0.0), ("DA_1", 2, None, None, 1.0), ("b", 3, "success", None, float("nan")), ("c", 4, "judge_error", None, 1.0), ("d", 5, "success", False, 1.0), ("e", 6, None, None, 0.5)]
    got = {r.id: (r.correct, r.all_failed) for r in canonical.canonical_clean(spark.createDataFrame(log, kind)).collect()}
    assert got == {"DA_1": (True, False), "b": (False, True), "c": (False, True), "d": (False, False), "e": (False, False)}
    failed = canonical.canonical_clean(spark.createDataFrame([("a", 1, "judge_error", None, 0.0)], kind))
    hit = spark.createDataFrame([(1, "a", "x", True)], "id long, source_id string, attack_type string, is_correct boolean")
    r = robust.robust_summary(hit, failed, "exclude").first()
    assert (r.paired_records, r.clean_dataset_accuracy, r.improved) == (1, 0.0, 1)


def test_metric_table(spark):
    clean = spark.createDataFrame([("a", True), ("b", False)], "id string, correct boolean")
    hit = spark.createDataFrame([(1, "a", "y", None), (2, "b", "x", True), (3, None, "", True), (4, "a", "x", True)], "id long, source_id string, attack_type string, is_correct boolean")
    rows = robust.metric_table(hit, clean).orderBy("position").collect()
    assert [r.group for r in rows] == ["overall", robust.MISSING, "x", "y"] and list(rows[0].asDict()) == [*robust.METRIC_COLUMNS, "position"]
    assert (rows[0].attack_records, rows[0].attacked_unique_sources, rows[0].source_clean_correct_support, rows[0].source_balanced_cra, rows[0].clean_dataset_correct) == (4, 2, 1, 0.5, 1)
    assert robust.METRIC_COLUMNS[0] == "group" and len(robust.METRIC_COLUMNS) == 26


def test_last_of_repeated_names_counts(spark):
    labels = spark.createDataFrame([("1", "a", "x", 1), ("1", "a", "y", 2)], "id string, name string, value string, ordinal long")
    r = scoring.score_answers(spark.createDataFrame([("DA_1", 1, "success", "@a[y]")], "id string, line long, status string, response string"), labels).first()
    assert (r.correct, r.n_fields) == (True, 1)


def test_one_model_only(spark):
    models = lambda *x: spark.createDataFrame([(v,) for v in x], "model string")
    assert canonical.single_model(models("m", " m ", "", None)).first().model == "m"
    for wrong in (models("m", "n"), models("", None)):
        with pytest.raises(Exception, match="exactly one model"):
            canonical.single_model(wrong).collect()


def test_policies(spark):
    clean = spark.createDataFrame([("a", True), ("b", False)], "id string, correct boolean")
    hit = spark.createDataFrame([(1, "a", "x", None), (2, "b", "x", True), (3, None, "", True), (4, "z", "x", True)], "id long, source_id string, attack_type string, is_correct boolean")
    r = robust.robust_summary(hit, clean, "incorrect").first()
    assert (r.attack_records, r.paired_records, r.missing_source, r.support, r.attack_successes, r.attack_success_rate, r.improved) == (4, 2, 1, 1, 1, 1.0, 1)
    r = robust.robust_summary(hit, clean, "exclude").first()
    assert (r.evaluated, r.support, r.attack_success_rate, r.attack_coverage) == (1, 0, None, 1.0)
    assert {x.attack_type for x in robust.robust_summary(hit, clean, by=["attack_type"]).collect()} == {"x", robust.MISSING}
    assert one(spark, robust.asr_cell(F.lit(25.0), F.lit(8))) == "25.00% (n=8)"


def test_empty_logs(spark):
    clean = spark.createDataFrame([], "id string, correct boolean")
    hit = spark.createDataFrame([], "id long, source_id string, attack_type string, is_correct boolean")
    r = robust.robust_summary(hit, clean).first()
    assert (r.attack_records, r.attack_success_rate, r.clean_dataset_accuracy) == (0, None, None)
    assert robust.robust_summary(hit, clean, by=["attack_type"]).count() == 0


def test_equivalence(spark):
    same = lambda a, b: one(spark, parse.values_equivalent(F.lit(a), F.lit(b)))
    assert same("2000-01-01", "2000/1/1") and same("1,234.00", "1234") and same("50%", "0.5") and same("yes", "TRUE") and same(None, None) and same("是", "true")
    assert not same("01/02/2000", "2000-01-02") and not same("1d", "1") and not same(None, "x") and not same("yes", "y")


def test_fields(spark):
    text = F.lit("@mean_fare[34.6500000001], @significance[significant] @mean_fare[34.6500000002]")
    assert one(spark, parse.extract_fields(text)) == {"mean_fare": "34.6500000002", "significance": "significant"}
    assert one(spark, parse.answers_equal(F.lit("34.6500000001"), F.lit("34.65"))) and not one(spark, parse.answers_equal(F.lit("Yes"), F.lit("yes")))
    assert one(spark, scoring.label_id(F.lit("DA_109__unit_scale_conversion__001"))) == "109"


def test_text(spark):
    assert one(spark, parse.final_answer(F.lit("a <Final_Answer> b\n</final_answer>"))) == "b"
    assert one(spark, parse.final_answer(F.lit("<final_answer></final_answer>x"))) == ""
    assert one(spark, parse.split_names(F.lit('a, b.csv; "c"\n\na, b.csv；d'))) == ["a, b.csv", "c", "d"]
    assert one(spark, parse.code_block(F.lit("x ```python\ny = 1\n``` z"))) == "y = 1"
    assert one(spark, parse.salvage_json(F.lit('so {"a": 1} done')).cast("string")) == '{"a":1}'
    assert one(spark, parse.nearest_score(F.lit(0.8))) == 1.0 and one(spark, parse.nearest_score(F.lit(0.25))) == 0.0
    assert one(spark, parse.truncate_middle(F.lit("abcdef"), 4)) == "ab\n...[2 omitted]...\nef"


def test_rounding(spark):
    values = [1 / 3, 2 / 3, 0.5, 0.0000005, 0.1234565, 0.045]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(q(F.col("x"), 6).alias("x"), plain(F.col("x")).alias("t")).collect()
    assert [r.x for r in got] == [round(v, 6) for v in values]
    assert got[2].t == "0.5"


def test_row_shuffle_is_a_permutation(spark):
    t = spark.range(200).select("id", (F.col("id") % 7).alias("v"))
    after = perturb.row_order_shuffle(t, ["id"])
    assert integrity.row_shuffle_check(grid.number_rows(t, ["id"]), after, ["id", "v"]).first().passed
    changed = after.withColumn("v", F.when(F.col("id") == 5, 99).otherwise(F.col("v")))
    assert not integrity.row_shuffle_check(grid.number_rows(t, ["id"]), changed, ["id", "v"]).first().passed


def test_column_shuffle():
    assert integrity.column_shuffle_check(list("abcd"), list("bcda"))["passed"] and not integrity.column_shuffle_check(list("abcd"), list("abdc"))["passed"]


def test_damage_is_found(spark):
    t = spark.createDataFrame([(i, float(i), f"n{i}") for i in range(20)], "k long, v double, n string")
    long = shape.wide_to_long(t, ["k"], ["v", "n"])
    assert {r.issue: r.n for r in shape.reshape_check(t, long.filter("k <> 3"), ["k"], ["v", "n"]).collect()}["reshape_inverse_mismatch"] == 2
    parts = shape.decompose(t, ["k"], {"a": ["v"], "b": ["n"]})
    parts["b"] = parts["b"].filter("k <> 3")
    assert {r.issue: r.n for r in shape.rejoin_check(t, parts, ["k"]).collect()}["orphan_join_record:b"] == 1
    scaled = perturb.unit_scale(t, "v", 100.0, "v_cents")
    assert integrity.unit_check(t, scaled, "k", "v", "v_cents").first().passed
    broken = scaled.withColumn("v_cents", F.when(F.col("k") == 7, 1.0).otherwise(F.col("v_cents")))
    assert not integrity.unit_check(t, broken, "k", "v", "v_cents").first().passed
    gone = perturb.data_missing(t, "v", F.col("k") == 4)
    assert integrity.missing_values_check(t, gone, "k", "v").first().passed
    assert not integrity.missing_values_check(t, gone.withColumn("n", F.lit("x")), "k", "v").first().passed
    assert integrity.equivalent_fields(t, "v", ["n"]).first().is_bijection


def test_non_observation_limits(spark):
    t = spark.createDataFrame([(i, f"c{i}") for i in range(10)], "k long, n string")
    assert integrity.non_observation_check(t, perturb.non_observation_rows(t, "k", 1)).first().passed
    assert not integrity.non_observation_check(t, perturb.non_observation_rows(t, "k", 7)).first().passed


def test_profile(spark):
    cells = [(1, 1, "Report"), (2, 1, "id"), (2, 2, "name"), (2, 3, "name"), (2, 4, ""), (3, 1, "1"), (3, 2, "x"), (3, 3, "2020-01-01"), (3, 4, "5%")]
    g = spark.createDataFrame([("f", "s", r, c, v) for r, c, v in cells], "file string, sheet string, row int, col int, value string")
    assert profile.header_row(g).first().header_row == 2 and profile.multirow_header(g).first().looks_multirow
    assert [r.name for r in profile.column_names(g.filter("row = 2")).orderBy("col").collect()] == ["id", "name", "name.1", "Unnamed: 3"]
    assert [r.dtype for r in profile.column_types(g, 2).orderBy("col").collect()] == ["number", "text", "date", "number"]


def test_selection(spark):
    rows = [("s", "a", 1, "0.5", 2), ("s", "a", 2, "0.5", 2), ("s", "b", 3, "bad", 1), ("s", "c", 4, "0.9", 2)]
    c = spark.createDataFrame(rows, "sample string, operator string, ordinal long, confidence string, priority int")
    assert {r.operator: (r.status, r.position) for r in select.select_attacks(c, 2).collect()} == {"b": ("selected", 1), "c": ("selected", 2), "a": ("skipped", 3)}
    assert {r.operator: r.ordinal for r in select.best_candidates(c).collect()}["a"] == 1


def test_source_ids(spark):
    df = spark.createDataFrame([(" qa_1 ", "x"), (None, "qa_12__op__001"), ("", "zz"), (None, None)], "source_id string, judgment_id string")
    assert [r[0] for r in df.select(reliability.source_of(F.col("source_id"), F.col("judgment_id"))).collect()] == ["QA_1", "QA_12", "", ""]


def test_value_checks_see_lost_rows_and_other_columns(spark):
    from gridproof.operators import integrity, perturb

    t = spark.range(100).selectExpr("id AS k", "cast(id * 10 + 10 AS double) AS v", "concat('n', id) AS name")
    scaled, recoded = perturb.unit_scale(t, "v", 100.0, "v_cents"), perturb.reencode(t, {"v": "thousands"})
    for good, check in ((scaled, lambda x: integrity.unit_check(t, x, "k", "v", "v_cents")), (recoded, lambda x: integrity.reencoding_check(t, x, "k", ["v"]))):
        passed = lambda x: check(x).first().passed  # noqa: B023, E731
        assert passed(good)
        assert not passed(good.filter("k < 50")) and not passed(good.unionByName(good.filter("k = 3").withColumn("k", F.lit(1000).cast("long"))))
        assert not passed(good.withColumn("name", F.lit("damaged"))) and not passed(good.withColumn("name", F.when(F.col("k") != 7, F.col("name"))))
    assert not integrity.unit_check(t, scaled.withColumn("v_cents", F.when(F.col("k") != 7, F.col("v_cents"))), "k", "v", "v_cents").first().passed
    with pytest.raises(ValueError, match="one side only"):
        integrity.unit_check(t, scaled.drop("name"), "k", "v", "v_cents")


def test_distractor_of_another_kind_fails(spark):
    from gridproof.operators import integrity

    t = spark.range(20).selectExpr("id AS k", "cast(id AS double) AS price", "cast(id * 2 + 1 AS double) AS list", "'no number' AS words")
    assert integrity.distractor_check(t, "price", "list").first().passed and not integrity.distractor_check(t, "price", "words").first().passed


def test_repeats_raise(spark):
    from gridproof.operators import scoring, shape

    long = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "a", "z")], "k long, field string, value string")
    with pytest.raises(Exception, match="a key repeats"):
        shape.long_to_wide(long, ["k"], ["a", "b"]).collect()
    assert shape.long_to_wide(long.filter("value <> 'z'"), ["k"], ["a", "b"]).first().asDict() == {"k": 1, "a": "x", "b": "y"}
    labels = spark.createDataFrame([("1", "n", "5"), ("1", "n", "4"), ("2", "m", "7"), ("2", "m", "7")], "id string, name string, value string")
    with pytest.raises(Exception, match="a label repeats"):
        scoring.last_labels(labels).collect()
    assert [tuple(r) for r in scoring.last_labels(labels.filter("id = '2'")).collect()] == [("2", "m", "7")]
    last = scoring.last_labels(labels.withColumn("ordinal", F.when(F.col("value") == "4", 2).otherwise(1))).collect()
    assert sorted(map(tuple, last)) == [("1", "n", "4"), ("2", "m", "7")]


def test_sheets_that_one_side_lacks_or_that_moved(spark):
    from gridproof.operators.structure import sheet_issues

    schema = "file string, sheet string, position int, rows int, cols int, merges array<string>, filter_ref string, tables array<string>, hidden_rows array<int>, hidden_cols array<string>, header_styles array<string>"
    row = lambda s, p: ("w.xlsx", s, p, 3, 2, [], None, [], [], [], ["1"])
    before = spark.createDataFrame([row("a", 1), row("b", 2), row("c", 3)], schema)
    after = spark.createDataFrame([row("a", 1), row("c", 2), row("d", 3)], schema)
    found = lambda o: {(r.sheet, r.code) for r in sheet_issues(before, after, o).collect()}
    assert found("unit_scale_conversion") == {("b", "sheet_names_changed"), ("c", "sheet_names_changed"), ("d", "sheet_names_changed")}
    assert found("excel_cross_sheet_relayout") == set() and sheet_issues(before.drop("position"), before, "row_order_shuffle").count() == 0
