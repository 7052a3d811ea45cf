"""Whitening of embeddings.

Entries become integers, so all sums are exact and do not depend on how rows are dealt to tasks. One aggregation holds a generated SQL
expression for each pair of dimensions of the upper triangle; the driver sees the one row of its sums, puts the covariance
matrix together and has LAPACK decompose it. Projection and deviations are column expressions too.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000  # an entry c becomes floor(SCALE * c) + SHIFT
PARTIALS = 256  # rows of sums that the tasks' sums come down to before they are added up by pair
EXPRESSIONS = 2600  # pairs of dimensions in one aggregation: all of up to 71 dimensions
LARGEST = 1 << 40  # of an entry's absolute value; beyond, longs would not tell integers apart
LONG = 1 << 63


@dataclass
class Whitening:
    """What fit() found: n vectors, their sums, an integer near each mean, the covariance, and components by falling variance (rows)."""

    n: int
    sums: list[int]
    centres: list[int]
    spread: int  # no entry lies farther from its centre
    covariance: np.ndarray
    variances: np.ndarray
    components: np.ndarray

    @property
    def offsets(self) -> list[float]:
        """The means, seen from the centres."""
        return [float(Fraction(s - c * self.n, self.n)) for s, c in zip(self.sums, self.centres)]

    @property
    def explained(self) -> list[float]:
        return [float(e / np.trace(self.covariance)) for e in self.variances]


def as_integers(table: DataFrame, vec_col: str = "embedding", into: str = "wh_x") -> DataFrame:
    """The rows whose vector is not null, not empty and has only finite entries, with `into`: its entries as longs (null beyond LARGEST)."""
    finite = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    kept = table.filter(F.coalesce(finite & (F.size(vec_col) > 0), F.lit(False)))
    whole = lambda c: F.when(F.abs(c) <= LARGEST, F.floor(F.lit(float(SCALE)) * c) + F.lit(SHIFT))
    return kept.withColumn(into, F.transform(vec_col, lambda c: whole(c.cast("double"))))


def _exact(bound: int) -> str:
    """The type in which integers up to bound add up without overflow."""
    return "bigint" if bound < LONG else "decimal(38, 0)"


def fit(vectors: DataFrame, components: int = 8, x: str = "wh_x") -> Whitening | None:
    """Covariance (divisor n) and leading components of the integer vectors; None if there are none.

    Vectors of the most frequent length count (of two, the greater length). Sums of products are taken about an integer next to each
    mean and corrected exactly, in decimals where a long could overflow. Components without variance, beyond rounding, are left out.
    """
    length = vectors.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return None
    d, n = length["d"], length["count"]
    of_length = vectors.filter(F.size(x) == d).select(x)
    entry = F.col("c").cast("decimal(38, 0)")
    each = of_length.select(F.posexplode(x).alias("i", "c")).groupBy("i").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.sum(entry).alias("s"), F.count("c").alias("n")).collect()  # d rows
    each.sort()
    low, high, sums = [r["low"] for r in each], [r["high"] for r in each], [int(r["s"]) for r in each]
    if min(r["n"] for r in each) < n:
        raise ValueError(f"an entry lies beyond {LARGEST}")
    centres = [round(Fraction(s, n)) for s in sums]
    spread = max(max(c - a, b - c) for a, b, c in zip(low, high, centres))
    kind = _exact(n * spread * spread)
    about = of_length.select(*[(F.col(x)[i] - F.lit(c)).alias(f"z{i}") for i, c in enumerate(centres)])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]  # the upper triangle
    products: list[int] = []
    for at in range(0, len(pairs), EXPRESSIONS):
        product = "z{} * z{}" if kind == "bigint" else "cast(z{} AS decimal(19, 0)) * cast(z{} AS decimal(19, 0))"
        sums_of = [F.expr(f"sum({product.format(i, j)})") for i, j in pairs[at : at + EXPRESSIONS]]
        parts = about.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTIALS))).groupBy("part").agg(F.array(*sums_of).alias("p"))
        total = parts.select(F.posexplode("p").alias("k", "p")).groupBy("k").agg(F.sum("p").alias("p")).collect()  # a row a pair
        products += [int(r["p"]) for r in sorted(total)]
    left = [s - c * n for s, c in zip(sums, centres)]
    covariance = np.zeros((d, d))
    for (i, j), p in zip(pairs, products):
        covariance[i, j] = covariance[j, i] = float(Fraction(n * p - left[i] * left[j], n * n))
    values, rows = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > d * np.finfo(float).eps * max(values.max(), 0)]
    return Whitening(n, sums, centres, spread, covariance, values[order], rows[:, order].T)


def _from_centres(model: Whitening, x: str) -> Column:
    return F.zip_with(x, F.array(*[F.lit(c).cast("long") for c in model.centres]), lambda c, m: c - m)


def projected(model: Whitening, x: str = "wh_x") -> Column:
    """The vector's place on each component, in standard deviations: an array of doubles."""
    y = F.zip_with(_from_centres(model, x), F.array(*map(F.lit, model.offsets)), lambda z, o: z.cast("double") - o)
    dot = lambda y, w: F.aggregate(F.zip_with(y, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    weights = [(v / np.sqrt(e)).tolist() for e, v in zip(model.variances, model.components)]
    return F.element_at(F.transform(F.array(y), lambda y: F.array(*[dot(y, w) for w in weights])), 1)  # y once a row


def deviation(model: Whitening, x: str = "wh_x") -> Column:
    """Sum over dimensions of (n * x - S) ** 2, exact: a long, or a decimal where some vector's could be too large for one."""
    kind = _exact(len(model.sums) * (model.n * (model.spread + 1)) ** 2)
    factor = "bigint" if kind == "bigint" else "decimal(19, 0)"
    left = F.array(*[F.lit(s - c * model.n).cast(factor) for s, c in zip(model.sums, model.centres)])
    each = F.zip_with(_from_centres(model, x), left, lambda z, r: (F.lit(model.n).cast("long") * z - r).cast(factor))
    return F.aggregate(each, F.lit(0).cast(kind), lambda s, t: (s + t * t).cast(kind))


def identity_error(vectors: DataFrame, model: Whitening, x: str = "wh_x") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity; 0 without components."""
    k = len(model.variances)
    if not k:
        return 0.0
    w = vectors.filter(F.size(x) == len(model.sums)).select(projected(model, x).alias("w")).select(*[F.col("w")[i].alias(f"w{i}") for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = w.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()  # centred as it goes
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, found))


def whiten(table: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Vectors that are null or empty, or hold null or non-finite entries, have no rows, nor have those of another length than the
    most frequent one. Null and repeated ids pass through, equal vectors each count. Components without variance are
    left out, so one vector alone, or only equal vectors, give no rows, and an empty table gives an empty one. Other columns are ignored. Entries beyond
    2**40 raise an error: as integers they can't be told apart.
    """
    vectors = as_integers(table.select(F.col(id_col).alias("wh_id"), F.col(vec_col).alias("wh_v")), "wh_v").select("wh_id", "wh_x")
    model = fit(vectors, components)
    if model is None or not len(model.variances):
        none = "long component, long n, long deviation, double whitened, double explained, double identity_error".split(", ")
        return vectors.limit(0).select(F.col("wh_id").alias(id_col), *[F.lit(None).cast("int" if name == "component" else kind).alias(name) for kind, name in map(str.split, none)])
    error = identity_error(vectors, model)
    rows = vectors.filter(F.size("wh_x") == len(model.sums)).select("wh_id", deviation(model).alias("deviation"), F.posexplode(projected(model)).alias("at", "whitened"))
    share = F.element_at(F.array(*map(F.lit, model.explained)), F.col("at") + 1)
    return rows.select(
        F.col("wh_id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"),
    )
