"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id of edges (a, b: bigint).

    Each round links all larger neighbours of a node, and then all smaller ones, to its least neighbour; edges never grow
    in number, and paths shrink by half or more. A hub with very many neighbours needs only its minimum, which is
    aggregated before the shuffle. Rounds are written to the shared folder. Self links and repeated edges do no harm.
    """
    links = written(edges.filter("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "edges")
    if links.isEmpty():
        return edges.selectExpr("a AS id", "a AS component").distinct()
    last = None
    for _ in range(MAX_ROUNDS):
        both = links.selectExpr("u AS x", "v AS y").union(links.selectExpr("v AS x", "u AS y"))
        least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        links = written(small.filter("u <> v").repartition("u", "v").distinct(), "edges", links)  # by both, so that a hub is not one task
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("v")).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    stars = links.selectExpr("u AS id", "v AS component")
    return stars.union(stars.select("component", "component").distinct())
