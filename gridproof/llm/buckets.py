"""Rows that meet by a key: hot keys are shared out over tasks, and each bucket is compared in numpy.

Which keys are hot is broadcast; as a key is hot only with over 1 / HOT_KEYS of all rows, there are HOT_KEYS of them at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1_000_000
TILE = 1024


def hot_limit(rows: int, most: int, keys: int = HOT_KEYS) -> int:
    """Rows from which on a key is hot: over `most`, and so many that there can't be more than `keys` hot keys."""
    return max(most, -(-rows // keys))


def join_counted(rows: DataFrame, side: DataFrame, keys: list[str], count: str, total: int, most: int = 100_000, hot_keys: int = HOT_KEYS) -> DataFrame:
    """rows joined on keys with side, which has one row a key and in `count` how many of `rows` have it: hot keys by broadcast, so that their rows stay where they are."""
    limit = hot_limit(total, most, hot_keys)
    hot, rest = side.filter(F.col(count) > limit), side.filter(F.col(count) <= limit)
    there = rows.join(F.broadcast(hot), keys, "left")
    return there.filter(F.col(count).isNotNull()).unionByName(there.filter(F.col(count).isNull()).select(*rows.columns).join(rest, keys))


def dealt(rows: DataFrame, member: str, total: int, most: int) -> DataFrame:
    """rows (key, owner: boolean, ...) with x, y: the parts of buckets in which they meet.

    Owners of a bucket have to meet each other and all other members, the probes; probes don't meet each other. A bucket of over `most` rows becomes pairs of
    blocks: owners with owners (x <= y) and owners with probes (y < 0), each block with all it has to meet. Hot buckets without owners are dropped.
    """
    limit = hot_limit(total, most)
    sizes = rows.groupBy("key").agg(F.count_if("owner").alias("own"), F.count("*").alias("all"))
    blocks = lambda n: F.ceil(n / limit).cast("int")
    hot = sizes.filter(F.col("all") > limit).select("key", blocks(F.col("own")).alias("ko"), blocks(F.col("all") - F.col("own")).alias("kp"))
    tagged = rows.join(F.broadcast(hot), "key", "left").filter("ko IS NULL OR ko > 0")
    i = F.pmod(F.xxhash64(member), F.when(F.col("owner"), F.col("ko")).otherwise(F.col("kp"))).cast("int")
    pair = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    owned = F.concat(F.transform(upto(F.col("ko")), lambda c: pair(F.least(i, c), F.greatest(i, c))), F.transform(upto(F.col("kp")), lambda j: pair(i, -1 - j)))
    probing = F.transform(upto(F.col("ko")), lambda c: pair(c, -1 - i))
    places = F.when(F.col("ko").isNull(), F.array(pair(F.lit(0), F.lit(0)))).when(F.col("owner"), owned).otherwise(probing)
    at = tagged.withColumn("at", F.explode(places))
    return at.select(*rows.columns, F.col("at.x").alias("x"), F.col("at.y").alias("y"), F.when(F.col("ko").isNull(), 0).otherwise(i).alias("block"))


def whole_buckets(frames: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of rows sorted by names, cut between buckets, each with the places at which buckets begin, and its length."""
    carry: list[pd.DataFrame] = []

    def closed(f: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        at = f[names].to_numpy()
        return f, np.append(np.flatnonzero(np.append(True, (at[1:] != at[:-1]).any(1))), len(at))

    for f in frames:
        if not len(f):
            continue
        new = (f[names] != f[names].iloc[-1]).any(axis=1).to_numpy()
        if carry and ((f[names].iloc[0] != carry[-1][names].iloc[-1]).any() or new.any()):
            yield closed(pd.concat([*carry, f[new]], ignore_index=True))
            carry = []
        elif new.any():
            yield closed(f[new].reset_index(drop=True))
        carry.append(f[~new])  # the last bucket may go on in the next frame
    if carry:
        yield closed(pd.concat(carry, ignore_index=True))


def forest(own: int, every: int, near: Callable[[slice, slice], np.ndarray]) -> list[tuple[int, int]]:
    """Links (places) that connect all of the first `own` places that are near each other or near one of the rest; tile by tile, and done once all are linked."""
    label = np.arange(every)
    out: list[tuple[int, int]] = []
    for i in range(0, own, TILE):
        for j in range(i, every, TILE):
            a, b = slice(i, min(i + TILE, own)), slice(j, min(j + TILE, every))
            close = near(a, b)
            while len(rows := np.flatnonzero((apart := close & (label[a][:, None] != label[b][None])).any(1))):
                r = i + rows[0]
                at = np.flatnonzero(apart[rows[0]])
                roots, first = np.unique(label[b][at], return_index=True)
                out += [(int(r), int(j + k)) for k in at[first]]
                label[np.isin(label, roots)] = label[r]
            if len(out) == every - 1:
                return out
    return out
