"""Quality rules with cross-document line frequency; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written

WORD_SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is boilerplate of its host when it stands in more documents than both allow.
LINE_DOCUMENTS = 20
LINE_SHARE = 0.0005
#: A document is depleted when fewer words, or a smaller share of them, are left.
LEAST_LEFT = 10
LEAST_SHARE = 0.3
BROADCAST_LINES = 200_000
SALTS = 32


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_SPACE), lambda w: w != "")


def _strip(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeated_words(words: Column) -> Column:
    """Words in windows of 8 that stand twice or more in the text: sort window hashes, keep those with an equal neighbour, cover."""

    def cover(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")), lambda a: a["n"])

    def repeated(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(p: Column) -> Column:
            n = F.size(p)
            twin = lambda e, k: ((k > 0) & (F.get(p, k - 1)["h"] == e["h"])) | ((k < n - 1) & (F.get(p, k + 1)["h"] == e["h"]))
            return cover(F.array_sort(F.transform(F.filter(p, twin), lambda e: e["i"])))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, same))

    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(_let(windows(words), repeated))


def _lines(text: Column) -> Column:
    """Lines that have a word, and for each normalised line once its hash and its words in all."""
    return F.filter(F.split(text, "\n"), lambda x: _strip(x, " \t\x0b\x0c\r") != "")


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, WORD_SPACE, " ")))


def base_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint) and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    stats = _let(_words(text), lambda w: F.struct(F.size(w).alias("n"), _repeated_words(w).alias("r")))
    out = docs.withColumn("q_words", stats)
    lines = _let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = out.withColumns({
        "n_words": F.col("q_words.n").cast("long"),
        "word_chars": F.length(_strip(text, " \t\n\x0b\x0c\r")).cast("long"),
        "n_symbols": (F.length(text) - F.length(_strip(text, SYMBOLS))).cast("long"),
        "n_dup_lines": lines.cast("long"),
        "n_repeat_words": F.col("q_words.r").cast("long"),
    }).drop("q_words")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _line_words(text: Column) -> Column:
    """Hash and words of each line that has a word, normalised: lower case, runs of white space to one space."""
    return F.transform(_lines(text), lambda x: _let(_normal(x), lambda t: F.struct(F.xxhash64(t).alias("h"), F.size(F.split(t, " ")).alias("n"))))


def frequent_lines(rows: DataFrame) -> DataFrame:
    """host, h of lines that stand in more documents of their host than both limits allow; rows has host and lines (of _line_words).

    Counts are partial sums before the shuffle, so a line in a third of all documents is one row a task.
    """
    each = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    sizes = rows.groupBy("host").agg(F.count("*").alias("docs"))
    often = each.groupBy("host", "h").agg(F.count("*").alias("in_docs")).filter(F.col("in_docs") > LINE_DOCUMENTS)
    return often.join(sizes, "host").filter(F.col("in_docs") > LINE_SHARE * F.col("docs")).select("host", "h")


def removed_words(rows: DataFrame, often: DataFrame) -> DataFrame:
    """row, removed: words in frequent lines; only rows that have such lines.

    Up to BROADCAST_LINES frequent lines (16 bytes and a host each) are broadcast. Beyond that a line's rows are spread over SALTS
    keys, so that one in a third of all documents is not one task.
    """
    flat = rows.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.n")
    if often.count() <= BROADCAST_LINES:
        met = flat.join(F.broadcast(often), ["host", "h"])
    else:
        salted = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = flat.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["host", "h", "salt"])
    return met.groupBy("row").agg(F.sum("n").alias("removed"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept for every row.

    Lines above the limits of their host are removed; a document is rejected when under LEAST_LEFT words, or under
    LEAST_SHARE of its words, are left, or when a base rule fails. Null and empty texts have no words and fail. A null
    host is a host of its own (with the empty name). Each row is a document of its own with a verdict of its own, also where rows
    repeat; null ids pass. Texts are read once: features and the hashes of lines are written, without the text. An empty table gives an empty table; other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(host_col), F.lit("")).alias("host"))
    lines = _line_words(F.coalesce(F.col("text"), F.lit("")))
    base = written(base_features(rows).withColumns({"lines": lines, "row": F.monotonically_increasing_id()}).drop("text"), "quality")
    often = written(frequent_lines(base), "lines")
    gone = F.coalesce(F.col("removed"), F.lit(0).cast("long")).cast("long")
    out = base.drop("lines").join(removed_words(base, often), "row", "left").withColumn("n_removed_words", gone)
    left = F.col("n_words") - F.col("n_removed_words")
    return out.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words",
        (~F.col("base_failed") & (left >= LEAST_LEFT) & (left >= LEAST_SHARE * F.col("n_words"))).alias("kept"),
    )
