"""Covers of number ranges by declared intervals, by running counts of starts and ends; intervals are never exploded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20  # places of one block of a running count


def depth(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end, depth: maximal runs of places (both ends count) that as many intervals (keys, start, end) hold, from the first to the last.

    Starts and ends are counted by place before any shuffle; counts run inside blocks of BLOCK places, and blocks add up on their own, so a
    key with very many intervals is shared out over tasks. Intervals that end before they start hold nothing.
    """
    real = intervals.filter("start <= end")
    events = real.select(*keys, F.col("start").alias("at"), F.lit(1).alias("d")).unionByName(real.select(*keys, (F.col("end") + 1).alias("at"), F.lit(-1).alias("d")))
    steps = events.groupBy(*keys, "at").agg(F.sum("d").alias("d")).withColumn("block", F.floor(F.col("at") / BLOCK))
    blocks = steps.groupBy(*keys, "block").agg(F.sum("d").alias("all"), F.min("at").alias("first"))
    of_key = Window.partitionBy(*keys).orderBy("block")  # one row a block
    bases = blocks.select(*keys, "block", F.coalesce(F.sum("all").over(of_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lead("first").over(of_key).alias("then"))
    inside = Window.partitionBy(*keys, "block").orderBy("at")
    runs = steps.join(bases, [*keys, "block"]).select(*keys, F.col("at").alias("start"), (F.coalesce(F.lead("at").over(inside), F.col("then")) - 1).alias("end"), (F.col("base") + F.sum("d").over(inside)).alias("depth"))
    return runs.filter("end IS NOT NULL")


def cover(declared: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, never, again, outside: places of wanted (keys, start, end: one range a key) that no declared interval holds, and how often places are declared beyond once, or outside of it. All keys of wanted come."""
    runs = depth(declared, keys).join(wanted.select(*keys, F.col("start").alias("lo"), F.col("end").alias("hi")), keys)
    size = F.col("end") - F.col("start") + 1
    within = F.greatest(F.lit(0), F.least("end", "hi") - F.greatest("start", "lo") + 1)
    sums = runs.groupBy(*keys).agg(F.sum(F.when(F.col("depth") > 0, within).otherwise(0)).alias("held"), F.sum(within * F.greatest(F.lit(0), F.col("depth") - 1)).alias("again"), F.sum((size - within) * F.col("depth")).alias("outside"))
    whole = wanted.select(*keys, (F.col("end") - F.col("start") + 1).alias("n")).join(sums, keys, "left").fillna(0, ["held", "again", "outside"])
    return whole.select(*keys, (F.col("n") - F.col("held")).alias("never"), "again", "outside")
