"""Closed-form scoring of answers of the form @name[value]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import answers_equal, field_pairs, last_value
from ..functions.rounding import rate


def label_id(x):
    """The id up to its first __, without the DA_ prefix."""
    head = F.trim(F.split_part(F.trim(x), F.lit("__"), F.lit(1)))
    return F.when(head.startswith("DA_"), F.substring(head, F.lit(4), F.length(head))).otherwise(head)


def last_labels(labels: DataFrame) -> DataFrame:
    """id, name, value with each name once an id: the one with the greatest ordinal. Without that column a name that repeats with another value raises: which is the last can't be told."""
    told = F.when(F.min("value").eqNullSafe(F.max("value")) & (F.count("value").isin(F.lit(0), F.count("*"))), F.max("value")).otherwise(F.raise_error(F.lit("a label repeats, and there is no ordinal")).cast("string"))
    value = F.max_by("value", "ordinal") if "ordinal" in labels.columns else told
    return labels.groupBy("id", "name").agg(value.alias("value"))


def score_answers(responses: DataFrame, labels: DataFrame) -> DataFrame:
    """id, label_id, status, correct, n_fields, n_right, wrong, missing of each response (id, line, status, response).

    labels has one row a field: id, name, value and maybe ordinal; of a repeated name the last counts. Checks go in this
    order: the run and its answer, then the label, then the fields.
    """
    keyed = last_labels(labels).groupBy(F.col("id").alias("label_id")).agg(F.collect_list(F.struct("name", "value")).alias("fields"))
    rows = responses.withColumn("label_id", label_id(F.col("id"))).join(keyed, "label_id", "left").withColumn("found", field_pairs(F.col("response")))
    rows = rows.withColumn("told", F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value"), last_value(F.col("found"), f["name"]).alias("got"))))
    told = F.filter("told", lambda f: answers_equal(f["got"], f["value"]))
    absent = F.filter("told", lambda f: f["got"].isNull())
    no_run = (F.col("status") != "success") | (F.coalesce(F.trim("response"), F.lit("")) == "")
    status = F.when(no_run, "run_failed").when(F.col("fields").isNull(), "label_not_found").otherwise("scored")
    scored = rows.withColumns({"status": status, "right": told, "absent": absent})
    names = lambda c: F.array_sort(F.transform(c, lambda f: f["name"]))
    wrong = F.array_except(F.array_except(names(F.col("fields")), names(F.col("right"))), names(F.col("absent")))
    n, k = F.size("fields"), F.size("right")
    ok = F.col("status") == "scored"
    return scored.select(
        "id", "label_id", "line", "status", F.when(ok, (n > 0) & (n == k)).alias("correct"), F.when(ok, n).cast("long").alias("n_fields"), F.when(ok, k).cast("long").alias("n_right"),
        F.when(ok, F.array_join(F.slice(wrong, 1, 20), ",")).alias("wrong"), F.when(ok, F.array_join(F.slice(names(F.col("absent")), 1, 20), ",")).alias("missing"),
    )


def last_scores(scores: DataFrame) -> DataFrame:
    """One row a label id: the last line wins."""
    best = F.max_by(F.struct("line", "correct", "n_fields", "n_right"), F.col("line"))
    return scores.groupBy("label_id").agg(best.alias("b")).select("label_id", "b.line", "b.correct", "b.n_fields", "b.n_right")


def dataset_report(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """labels, matched, correct, question_accuracy and fields, right_fields, field_accuracy over all labels; unanswered ones are wrong."""
    sizes = last_labels(labels).groupBy(F.col("id").alias("label_id")).agg(F.count("*").alias("fields"))
    rows = sizes.join(last_scores(scores), "label_id", "left")
    sums = rows.agg(
        F.count("*").alias("labels"), F.count("line").alias("matched"), F.count_if(F.coalesce("correct", F.lit(False))).alias("correct"), F.sum("fields").alias("fields"), F.coalesce(F.sum("n_right"), F.lit(0)).alias("right_fields")
    )
    return sums.select("labels", "matched", "correct", rate(F.col("correct"), F.col("labels"), 4).alias("question_accuracy"), "fields", "right_fields", rate(F.col("right_fields"), F.col("fields"), 4).alias("field_accuracy"))


def concept_accuracy(scores: DataFrame, concepts: DataFrame) -> DataFrame:
    """concept, questions, correct, accuracy; concepts has id and an array of concepts."""
    rows = concepts.select(F.col("id").alias("label_id"), F.explode(F.array_distinct("concepts")).alias("concept")).join(last_scores(scores), "label_id", "left")
    sums = rows.groupBy("concept").agg(F.count("*").alias("questions"), F.count_if(F.coalesce("correct", F.lit(False))).alias("correct"))
    return sums.withColumn("accuracy", rate(F.col("correct"), F.col("questions"), 4))
