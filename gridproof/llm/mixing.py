"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written
from .buckets import join_counted

BROADCAST_NUMBERS = 2_000_000  # of all cumulative arrays together, 8 bytes each
HOT_SOURCES = 1000  # at most so many sources have over 1 / HOT_SOURCES of all rows
DEVIATIONS = 12  # of the mean to both sides, and TAIL more; beyond lies less than any u can tell
TAIL = 30


def _uniform(*parts) -> F.Column:
    """A number in [0, 1) from the first 13 hex digits of an md5; the same everywhere."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cumulative(rate: float) -> tuple[int, np.ndarray]:
    """(low, P(N <= low), P(N <= low + 1), ...) of a Poisson number N with this mean, over all places that count; from logarithms, so that no rate underflows."""
    if not rate > 0:
        return 0, np.ones(1)
    reach = DEVIATIONS * math.sqrt(rate) + TAIL
    low, high = max(0, math.floor(rate - reach)), math.ceil(rate + reach)
    first = low * math.log(rate / low) + low - rate - (0.5 * math.log(2 * math.pi * low) + 1 / (12 * low) - 1 / (360 * low**3)) if low else -rate
    log_p = first + np.cumsum(np.log(rate / np.arange(low + 1, high + 1)))
    return low, np.cumsum(np.exp(np.append(first, log_p)))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.7, total: float = 1.0, source_col: str = "source") -> DataFrame:
    """mix_source, mix_rate, mix_low, mix_cdf, mix_rows: the mean number of copies that brings each source to its share of total x rows documents, and its cumulative distribution.

    Without weights the shares go as rows ** exponent. Sources without a weight, or with weight 0, get rate 0. A null
    source is a source of its own (weights then name it None).
    """
    sizes = written(docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count("*").alias("mix_rows")), "sources")
    if weights is None:
        w = F.pow(F.col("mix_rows").cast("double"), F.lit(float(exponent)))
    else:
        w = F.lit(0.0)
        for k, v in weights.items():
            w = F.when(F.col("mix_source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(w)
    weighed = sizes.withColumn("mix_weight", w)
    sums = weighed.agg(F.sum("mix_weight").alias("w"), F.sum("mix_rows").alias("n")).first()
    scale = total * (sums["n"] or 0) / sums["w"] if sums["w"] else 0.0

    @F.pandas_udf("low long, cdf array<double>")
    def distribution(rate: pd.Series) -> pd.DataFrame:  # one row a source
        return pd.DataFrame([cumulative(r) for r in rate], columns=["low", "cdf"])

    rates = weighed.select("mix_source", "mix_rows", (F.col("mix_weight") * F.lit(scale) / F.col("mix_rows")).alias("mix_rate"))
    return written(rates.withColumn("d", distribution("mix_rate")).select("mix_source", "mix_rate", F.col("d.low").alias("mix_low"), F.col("d.cdf").alias("mix_cdf"), "mix_rows"), "rates")


def _name(source: Column) -> Column:
    """A text that tells null from all sources."""
    return F.concat(F.when(source.isNull(), "0").otherwise("1"), F.coalesce(source.cast("string"), F.lit("")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.7, total: float = 1.0, seed: str = "mix", partitions: int | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Copies of the rows of docs (all columns), with copy (from 0) and mix_key; rows are dealt in the order of mix_key.

    Each row has a number u hashed from seed and id; its copies are the inverse of the Poisson distribution with its
    source's rate at u: the least k with u < P(N <= k). So a row with rate 0.4 is often left out and one with rate 3 comes about three times. The result
    is shuffled globally: mix_key is a second hash, even over its range, and each partition (by default as many as
    spark.sql.shuffle.partitions) takes an equal part of the range, sorted. Null ids hash as one id; repeated rows share u and so
    their number of copies. Null and long texts pass unchanged. An empty table gives an empty table. Columns named
    copy or mix_key in docs are replaced, all others come back as they are. Rates and distributions are broadcast up to BROADCAST_NUMBERS numbers; beyond, those of sources with very many rows are, and the others joined.
    """
    spark = docs.sparkSession
    rates = source_rates(docs, weights, exponent, total, source_col)
    rows = docs.drop("copy", "mix_key")
    kept = rows.select(F.struct(*rows.columns).alias("mix_row"), F.col(id_col).alias("mix_id"), _name(F.col(source_col)).alias("mix_name"), _uniform(F.lit(seed), F.col(id_col)).alias("mix_u"))  # whatever columns docs have, none clashes
    side = rates.select(_name(F.col("mix_source")).alias("mix_name"), "mix_low", "mix_cdf", "mix_rows")
    numbers = rates.agg(F.sum(F.size("mix_cdf") + 8), F.sum("mix_rows")).first()
    if (numbers[0] or 0) <= BROADCAST_NUMBERS:
        with_rate = kept.join(F.broadcast(side), "mix_name")
    else:  # the largest sources by broadcast, as their rows would be one task
        with_rate = join_counted(kept, side, ["mix_name"], "mix_rows", numbers[1], hot_keys=HOT_SOURCES)
    n = (F.col("mix_low") + F.size(F.filter("mix_cdf", lambda c: c <= F.col("mix_u")))).cast("int")
    copies = with_rate.select("mix_row", "mix_id", n.alias("mix_n")).filter("mix_n > 0").withColumn("copy", F.explode(F.expr("sequence(0, mix_n - 1)")))
    keyed = copies.select("mix_row", "copy", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("mix_id").cast("string"), F.lit("-")), F.col("copy").cast("string"))).alias("mix_key"))
    keyed = keyed.select(*[F.col("mix_row").getField(c).alias(c) for c in rows.columns], "copy", "mix_key")
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * parts).cast("int")
    return keyed.repartitionById(parts, place).sortWithinPartitions("mix_key")
