"""Guarded parsing and comparison of table values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number in text, and words for truth.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TRUE_WORDS = ("是", "yes", "true", "y")
FALSE_WORDS = ("否", "no", "false", "n")
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyy-M-d H:m:s", "yyyy/M/d H:m:s")
DATE_PATTERNS = (r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{4}/\d{1,2}/\d{1,2}$", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$")
TOLERANCE = 1e-6


def has_text(x: Column) -> Column:
    return F.coalesce(x.rlike(r"(?U)\S"), F.lit(False))


def parse_plain_number(x: Column) -> Column:
    """A double for text that is a plain decimal number, else null. Java's forms like 1d or 0x1p3 are no numbers."""
    t = F.trim(x)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def parse_number(x: Column) -> Column:
    """As parse_plain_number, after thousands separators are taken out; a trailing % divides by 100."""
    t = F.replace(F.trim(x), F.lit(","), F.lit(""))
    percent = t.endswith("%")
    body = F.when(percent, F.expr("null")).otherwise(t)
    body = F.when(percent, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(body)
    n = F.when(body.rlike(NUMBER), body.try_cast("double"))
    return F.when(percent, n / 100).otherwise(n)


def parse_date(x: Column) -> Column:
    """A timestamp for year-first dates with - or /, with or without a time; anything else is ambiguous and null."""
    t = F.trim(x)
    return F.coalesce(*[F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f))) for p, f in zip(DATE_PATTERNS, DATE_FORMATS)])


def parse_truth(x: Column) -> Column:
    t = F.lower(F.trim(x))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def is_close(a: Column, b: Column, rel: float = 1e-9, least: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(least))


def answers_equal(response: Column, label: Column) -> Column:
    """Equal text, or two numbers closer than the tolerance; a missing side is unequal."""
    a, b = parse_plain_number(response), parse_plain_number(label)
    return F.coalesce((response == label) | (F.abs(a - b) < F.lit(TOLERANCE)), F.lit(False))


def values_equivalent(a: Column, b: Column) -> Column:
    """Two texts stand for one value: dates with dates, numbers with numbers, a boolean (true or false) with a word for it, else equal trimmed text."""
    boolean = lambda x: F.lower(F.trim(x)).isin("true", "false")
    da, db, na, nb, ta, tb = parse_date(a), parse_date(b), parse_number(a), parse_number(b), parse_truth(a), parse_truth(b)
    return (
        F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull())
        .when(da.isNotNull() | db.isNotNull(), F.coalesce(da == db, F.lit(False)))
        .when(na.isNotNull() | nb.isNotNull(), F.coalesce(is_close(na, nb, 1e-12, 1e-12), F.lit(False)))
        .when((boolean(a) | boolean(b)) & ta.isNotNull() & tb.isNotNull(), ta == tb)
        .otherwise(F.trim(a) == F.trim(b))
    )


def family(x: Column) -> Column:
    """blank, boolean, number, date or text."""
    t = F.lower(F.trim(x))
    return F.when(~has_text(x), "blank").when(t.isin("true", "false", "yes", "no"), "boolean").when(parse_number(x).isNotNull(), "number").when(parse_date(x).isNotNull(), "date").otherwise("text")


def field_pairs(x: Column) -> Column:
    """All @name[value] in a text, in order, as structs of k and v; one pass of one expression."""
    whole = F.regexp_extract_all(x, F.lit(r"@(?U:\w+)\[(?s:.*?)\]"), F.lit(0))

    def parts(m: Column) -> Column:
        n = F.length(F.substring_index(m, "[", 1))
        return F.struct(F.substring(m, F.lit(2), n - 1).alias("k"), F.substring(m, n + 2, F.length(m) - n - 2).alias("v"))

    return F.transform(whole, parts)


def last_value(pairs: Column, name: Column) -> Column:
    """The value of the last pair of that name, or null."""
    return F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(-1))["v"]


def extract_fields(x: Column) -> Column:
    """Map of all @name[value] in a text; of a repeated name the last counts."""
    pairs = field_pairs(x)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda r: r["k"] == p["k"]))
    return F.map_from_entries(last)


def salvage_json(x: Column) -> Column:
    """The JSON of a text without the fences of a code block, or of its outermost braces; null if neither parses."""
    bare = F.regexp_replace(F.regexp_replace(x, r"^\s*```\w*\s*", ""), r"\s*```\s*$", "")
    return F.coalesce(F.try_parse_json(x), F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(x, r"(?s)\{.*\}", 0)))


def final_answer(x: Column) -> Column:
    """What stands in <final_answer> tags (an empty tag counts), else the whole text; trimmed."""
    pattern = r"(?is)<final_answer>(.*?)</final_answer>"
    return F.regexp_replace(F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1)).otherwise(x), r"^\s+|\s+$", "")


def final_answer_source(x: Column) -> Column:
    """Where final_answer took its text from: tag or text."""
    return F.when(x.isNotNull(), F.when(x.rlike(r"(?is)<final_answer>(.*?)</final_answer>"), "tag").otherwise("text"))


def first_text(*options: Column) -> Column:
    """The first of the columns that is not blank, as it stands; else empty."""
    return F.coalesce(*[F.when(has_text(c), c) for c in options], F.lit(""))


def answer_to_judge(final: Column, raw: Column, model_response: Column, response: Column, legacy: Column) -> Column:
    """The answer that a correctness judge reads: of the prediction's final and raw answer, then of three older fields, the first that is not blank."""
    return first_text(final, raw, model_response, response, legacy)


def answer_to_refuse(final: Column, raw: Column) -> Column:
    """The answer that a refusal judge reads: the final one if it is not blank, else the raw one even if it is; older fields don't count."""
    return F.coalesce(F.when(has_text(final), final), raw, F.lit(""))


def generated_tokens(candidates: Column, thoughts: Column) -> Column:
    """Tokens that a model has generated: those of its answer and of its thoughts; a missing number is 0."""
    zero = F.lit(0).cast("long")
    return F.coalesce(candidates.cast("long"), zero) + F.coalesce(thoughts.cast("long"), zero)


def folded(x: Column) -> Column:
    """Text for sorting without case, with the sharp s as ss."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def optional_number(x: Column) -> Column:
    """A long, or null for blank text, the words none and null, and 0."""
    t = F.lower(F.trim(x))
    return F.when(~t.isin("", "none", "null"), F.nullif(t.try_cast("long"), F.lit(0).cast("long")))


def truncate_middle(x: Column, limit: int) -> Column:
    """Head and tail of a long text with the number of characters left out between them."""
    half, n = limit // 2, F.length(x)
    cut = F.concat(F.substring(x, 1, half), F.lit("\n...["), (n - 2 * half).cast("string"), F.lit(" omitted]...\n"), F.right(x, F.lit(half)))
    return F.when(n > limit, cut).otherwise(x)


def split_names(x: Column) -> Column:
    """Names separated by line ends or semicolons (a comma is part of a name); trimmed, without repeats, in order."""
    parts = F.transform(F.split(x, r"[\r\n;；]+"), lambda s: F.trim(F.replace(F.trim(s), F.lit('"'), F.lit(""))))
    return F.array_distinct(F.filter(parts, lambda s: s != ""))


def code_block(x: Column) -> Column:
    """The first fenced block of a text, else the first in single backticks, else the text."""
    fenced, ticked = r"(?s)```(?:\w+\n)?(.*?)```", r"(?s)`([^`]*)`"
    return F.when(x.rlike(fenced), F.regexp_replace(F.regexp_extract(x, fenced, 1), r"^\s+|\s+$", "")).when(x.rlike(ticked), F.regexp_extract(x, ticked, 1)).otherwise(x)


def question_text(question: Column, constraints: Column, answer_format: Column) -> Column:
    """The parts of a question that are not blank, joined by blank lines."""
    part = lambda head, c: F.when(has_text(c), F.concat(F.lit(head), F.trim(c)))
    return F.concat_ws("\n\n", F.when(has_text(question), F.trim(question)), part("Constraints: ", constraints), part("Required output format: ", answer_format))


def attack_id(sample: Column, operator: Column, index: Column) -> Column:
    return F.concat_ws("__", sample, operator, F.lpad(index.cast("string"), 3, "0"))


def nearest_score(x: Column) -> Column:
    """The nearest of 0, 0.5 and 1; ties go down, and a value that is no number is 0; null stays null."""
    best = F.array_min(F.transform(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)), lambda s: F.struct(F.abs(s - x).alias("d"), s.alias("s"))))
    return F.when(x.isNotNull(), best["s"])


def correctness_score(x: Column) -> Column:
    """1 or 0 for a judge's score as text: its whole part if that is 0 or 1, else (and for what is no number) 0."""
    n = F.trim(x).try_cast("double")
    return F.when(F.coalesce((n >= 1) & (n < 2), F.lit(False)), 1).otherwise(0)


def correctness_label(label: Column, score: Column) -> Column:
    """The label if it is a known one, else by the score."""
    return F.when(F.trim(label).isin("correct", "incorrect"), F.trim(label)).when(score == 1, "correct").otherwise("incorrect")


def refusal_label(score: Column) -> Column:
    return F.when(score >= 1, "full_refusal").when(score == 0.5, "partial_refusal").when(score == 0, "no_refusal")


def declared_rows(first: Column, last: Column) -> Column:
    """The rows from first to last (last alone may be missing) as an array; an order that is turned round gives none."""
    end = F.coalesce(last, first)
    return F.when(end >= first, F.sequence(first, end)).otherwise(F.array().cast("array<long>"))


def json_number(x: Column) -> Column:
    """A double that JSON can hold: NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def json_time(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
