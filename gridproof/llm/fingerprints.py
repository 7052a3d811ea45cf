"""Homomorphic multiset fingerprints of documents; DataFrame functions only.

A text is cut into paragraphs (lines), and paragraphs into units: up to 8 words, ended early by the end of the line or
by a sentence mark from the fourth word on, so an edit in one sentence leaves the units of the others alone. Units cover every character but line ends,
so a paragraph gives the same units wherever it stands, at the end of a text too, and empty lines give none; only a text of nothing but line ends is one unit.
Each unit hashes to a wide vector of LANES entries of +1 or -1; the fingerprint is the sum over all units, each lane
modulo 2**16, as 4 hex digits a lane. So it does not depend on the order of units, and paragraphs can be added to a fingerprint or
taken away from it (inserted, deleted) without the rest of the text. Whole paragraphs would be too coarse: many texts are one paragraph, and an edit
in it would leave no likeness. With entries of +1 or -1 the cosine of two fingerprints estimates how many units their texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written
from .buckets import hot_limit, join_counted

HASHES = 2
LANES = 64 * HASHES
_PAIR = (1 << 32) + 1  # two counters of 32 bits in one long
UNIT = r"\A\n++\Z|(?:\S*+[^\S\n]++){0,3}+(?:[^\s.!?]*+[^\S\n]++){0,4}+[^\s.!?]*+(?:[.!?]++[^\S\n]*+|[^\S\n]++|(?=\n)|$)"
BELOW_ONE = 1 - 1e-9  # likeness of fingerprints that differ, at most
HOT_ROWS = 10_000  # rows of one id that one task takes


def units(text: Column) -> Column:
    """Units of a text in order; together they are the text without its line ends."""
    return F.filter(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: u != "")


def _sums(unit: Column) -> list[Column]:
    """Sums of bits of the hashes of all units; a long holds the counters of bits i and i + 32."""
    out = []
    for h in range(HASHES):
        hashed = F.xxhash64(unit, F.lit(h))
        out += [F.sum(F.when(unit.isNotNull(), F.shiftrightunsigned(hashed, i).bitwiseAND(F.lit(_PAIR))).otherwise(F.lit(0))) for i in range(32)]
    return out


def unit_counters(rows: DataFrame, keys: list[str], units_col: str) -> DataFrame:
    """keys, n (units), c (LANES / 2 longs of two counters each) for each row of keys; rows without units get zeros."""
    flat = rows.select(*keys, F.explode_outer(units_col).alias("u"))
    sums = flat.groupBy(*keys).agg(F.count("u").alias("n"), *[s.alias(f"c{i}") for i, s in enumerate(_sums(F.col("u")))])
    return sums.select(*keys, "n", F.array(*[F.col(f"c{i}") for i in range(LANES // 2)]).alias("c"))


def lanes(n: Column, c: Column) -> Column:
    """Signed sums of all lanes, from the counters: +1 for each set bit, -1 for each other."""
    low = F.transform(c, lambda x: 2 * x.bitwiseAND(F.lit(0xFFFFFFFF)) - n)
    high = F.transform(c, lambda x: 2 * F.shiftrightunsigned(x, 32) - n)
    return F.concat(low, high)


def digest(vector: Column) -> Column:
    """4 hex digits a lane: its sum modulo 2**16."""
    return F.lower(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(F.pmod(x, F.lit(65536))), 4, "0")), ""))


def reduced(vector: Column) -> Column:
    """A vector as its fingerprint holds it: each lane modulo 2**16, from -2**15 on."""
    return F.transform(vector, lambda x: F.pmod(x + 32768, F.lit(65536)) - 32768)


def parsed(fingerprint: Column) -> Column:
    """The reduced vector of a fingerprint's hex digits."""
    lane = lambda i: F.conv(F.substring(fingerprint, 4 * i + 1, F.lit(4)), 16, 10).cast("long")
    return reduced(F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lane))


def inserted(fingerprint: Column, other: Column) -> Column:
    """The fingerprint of a text with the paragraphs of another one, from the fingerprints of both."""
    return digest(F.zip_with(parsed(fingerprint), parsed(other), lambda a, b: a + b))


def deleted(fingerprint: Column, other: Column) -> Column:
    """The fingerprint of a text without the paragraphs of another one, all of which it has."""
    return digest(F.zip_with(parsed(fingerprint), parsed(other), lambda a, b: a - b))


def alike(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, from their hex digits."""
    return likeness(parsed(a), parsed(b))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two vectors, not below 0; two zero vectors are alike, and only equal vectors have exactly 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(a == b, F.lit(1.0)).when(norm == 0, F.lit(0.0)).otherwise(F.least(F.greatest(dot(a, b) / norm, F.lit(0.0)), F.lit(BELOW_ONE)))


def _neighbours(ids: DataFrame) -> DataFrame:
    """k, next: for each distinct key the next smaller one; for the smallest the largest.

    Keys are sorted by range and numbered inside their partition; only the first key of each partition meets those of
    other partitions, so no task holds all keys.
    """
    parts = written(ids.distinct().repartitionByRange("k").withColumn("part", F.spark_partition_id()), "ranges")  # ranges come from a sample: read once
    inside = parts.withColumn("next", F.lag("k").over(Window.partitionBy("part").orderBy("k")))
    edges = parts.groupBy("part").agg(F.max("k").alias("top"))
    before = Window.orderBy("part")
    edges = edges.withColumn("below", F.coalesce(F.lag("top").over(before), F.max("top").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))  # one row a partition
    return inside.join(edges.select("part", "below"), "part").select("k", F.coalesce("next", "below").alias("next"))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint of every row; a null text is empty, and an empty one has the zero fingerprint. Null ids and repeated rows pass through."""
    rows = docs.select(F.col(id_col).alias("id"), units(F.coalesce(F.col(text_col), F.lit(""))).alias("u")).withColumn("row", F.monotonically_increasing_id())
    return unit_counters(rows, ["id", "row"], "u").select(F.col("id").alias(id_col), digest(lanes(F.col("n"), F.col("c"))).alias("fingerprint"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last floor(n_chars / 3) code points replaced by as many of the first of the next document
    (all, if it has fewer). Next is the next smaller id; after the smallest comes the largest. A null text is empty; an
    empty text has the zero fingerprint. A null id counts as the smallest long. Rows that repeat an id
    have the same next id, whose first text in order then is taken; each row gets a result. A table of one document
    is next to itself, an empty one gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    k = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(k.alias("k"), text.alias("text"))
    # ids of very many rows (bounded in number, so they are broadcast) are shared out over tasks, all others move once: every use below takes these two columns
    limit = hot_limit(docs.count(), HOT_ROWS)
    hot = F.broadcast(written(rows.groupBy("k").count().filter(F.col("count") > limit).select("k", F.ceil(F.col("count") / limit).cast("int").alias("parts")), "hot-ids"))
    several = not hot.isEmpty()
    at = (rows.join(hot, "k", "left_anti") if several else rows).repartition("k")
    n = F.char_length("text").cast("int")
    tail = F.floor(n / 3).cast("int")
    near = _neighbours(docs.select(k.alias("k")))
    often = rows.join(hot, "k").withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts")).cast("int"))
    parted = lambda of: of(at).unionByName(of(often)) if several else of(at)
    need = parted(lambda t: t.select("k", tail.alias("need")).groupBy("k").agg(F.max("need").alias("need"))).join(near, "k")
    first = parted(lambda t: t.groupBy("k").agg(F.min_by("text", F.xxhash64("text")).alias("head")))
    heads = first.join(need.select(F.col("next").alias("k"), F.col("k").alias("to"), "need"), "k")
    heads = heads.select(F.col("to").alias("k"), F.col("k").alias("next"), F.expr("substring(head, 1, need)").alias("head"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("head"), F.lit(1), tail))
    joined = at.join(heads, "k")
    if several:
        spread = heads.join(hot, "k").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        joined = joined.unionByName(often.drop("parts").join(spread, ["k", "part"]).drop("part"))
    both = joined.withColumn("edited", edited).withColumn("row", F.monotonically_increasing_id())
    doc = F.struct("row", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("text").alias("order"))
    side = lambda i, t: F.struct(F.lit(i).alias("side"), units(F.col(t)).alias("u"))
    keyed = both.select("k", "next", doc.alias("doc"), F.explode(F.array(side(0, "text"), side(1, "edited"))).alias("s")).select("k", "next", "doc", "s.side", "s.u")
    counted = unit_counters(keyed, ["k", "next", "doc", "side"], "u")
    pick = lambda i, name: F.max(F.when(F.col("side") == i, F.col(name)))
    sums = counted.groupBy("k", "next", "doc").agg(pick(0, "n").alias("n"), pick(0, "c").alias("c"), pick(1, "n").alias("en"), pick(1, "c").alias("ec"))
    sums = written(sums, "fingerprints")  # read twice below
    after = sums.groupBy("k").agg(F.min_by(F.struct("n", "c"), F.col("doc.order")).alias("after")).withColumnRenamed("k", "next")
    vector = lambda n, c: reduced(lanes(F.col(n), F.col(c)))
    after = after.join(sums.groupBy("next").agg(F.count("*").alias("rows")), "next")
    vectors = join_counted(sums, after, ["next"], "rows", sums.count(), HOT_ROWS).select(F.nullif(F.col("k"), F.lit(-(1 << 63))).alias("id"), "doc", vector("n", "c").alias("a"), vector("en", "ec").alias("b"), vector("after.n", "after.c").alias("d"))
    return vectors.select(
        F.col("id").alias(id_col), "doc.n_chars", "doc.edited_sha256", digest(F.col("a")).alias("fingerprint"), digest(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("d")).alias("near_next"),
    )
