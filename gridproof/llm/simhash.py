"""SimHash near-duplicates, linked by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from .buckets import dealt, forest, join_counted, whole_buckets
from .components import connected_components

SEED = 42
BLOCK = 8192  # members and probes of a bucket in one task


def simhash(text: str | None, shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half of the XXH64 hashes of the word shingles (repeats included); no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    view, h = memoryview(flat), xxhash.xxh64_intdigest
    last = ends[min(shingle, len(words)) - 1 :]
    hashes = np.fromiter((h(view[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fps = np.array([simhash(t, shingle) for t in f["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": f["id"].astype("Int64"), "fp": fps})

    return docs.selectExpr(f"cast(`{id_col}` as long) AS id", f"`{text_col}` AS text").mapInPandas(run, "doc_id long, fp long")


def _balls(fps: DataFrame) -> DataFrame:
    """key (segment, value), fp, owner: each fingerprint's own two 32-bit segments, and the values with one more bit set.

    With 3 differing bits at most, one of the two segments differs in one bit or none. Of two values that differ in one bit,
    only the one without it enumerates the other, so each such pair meets once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bit = np.uint64(1) << np.arange(32, dtype=np.uint64)
        for f in frames:
            fp = f["fp"].to_numpy().view(np.uint64)
            for i in range(0, len(fp), 2000):
                own = fp[i : i + 2000]
                for segment in (0, 1):
                    value = own >> np.uint64(32) if segment else own & np.uint64(0xFFFFFFFF)
                    top = np.uint64(segment) << np.uint64(32)
                    row, b = np.nonzero((value[:, None] & bit) == 0)
                    keys = np.concatenate([value | top, (value[row] | bit[b]) | top])
                    yield pd.DataFrame({"key": keys.view(np.int64), "fp": np.concatenate([own, own[row]]).view(np.int64), "owner": np.arange(len(keys)) < len(own)})

    return fps.mapInPandas(run, "key long, fp long, owner boolean")


def near_edges(fps: DataFrame, distance: int = 3) -> DataFrame:
    """a, b: links between distinct fingerprints (fp) that connect all within `distance` (3 at most) bits.

    Members and probes of a bucket meet in one partition in sorted order and are compared in numpy, tile by tile; a bucket
    gives a forest of links instead of all its pairs, so a large group of near copies gives fewer links than it has members.
    Buckets of over BLOCK members and probes are compared block by block in tasks of their own; those that no fingerprint owns are dropped where they are hot.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of one bit find 3 differing bits at most")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, edges in whole_buckets(frames, ["key", "x", "y"]):
            fp, owner = f["fp"].to_numpy().view(np.uint64), f["owner"].to_numpy().astype(bool)
            members = np.add.reduceat(owner.astype(np.int64), edges[:-1])
            sizes = np.diff(edges)
            out: list[np.ndarray] = []
            two = edges[:-1][(members > 0) & (sizes == 2)]  # most buckets
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
            out.append(np.stack([fp[near], fp[near + 1]], 1))
            for k in np.flatnonzero((members > 0) & (sizes > 2)).tolist():
                at = slice(edges[k], edges[k + 1])
                own, every = int(members[k]), np.concatenate([fp[at][owner[at]], fp[at][~owner[at]]])
                links = forest(own, len(every), lambda a, b: np.bitwise_count(every[a][:, None] ^ every[b][None]) <= distance)  # noqa: B023
                out.append(every[np.array(links, np.int64).reshape(-1, 2)])
            links = np.concatenate(out).view(np.int64)
            yield pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    balls = dealt(_balls(fps), "fp", fps.count() * 34, BLOCK)
    return balls.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id for every row.

    Documents link when their fingerprints differ in `distance` bits at most; component_id is the smallest id
    reachable, the document itself included. Null texts and texts without words have fingerprint zero and link like others.
    Equal fingerprints are one node, so copies cost nothing and are never paired. Rows that repeat an id share
    its component; a null id links, but names a component only where it has no other id (then null). Very long texts
    are hashed whole, an empty table gives an empty table, and other columns are ignored.
    """
    prints = written(fingerprints(docs, shingle, id_col, text_col), "simhash")
    # an id that repeats with different texts ties their fingerprints together
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("docs")), "simhash-nodes")
    edges = near_edges(nodes.select("fp"), distance)
    repeated = prints.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("doc_id IS NOT NULL AND a <> b")
    tied = prints.join(repeated.select("doc_id", "a"), "doc_id").select("a", F.col("fp").alias("b")).filter("a <> b").distinct()
    groups = connected_components(edges.union(tied)).withColumnRenamed("id", "fp")
    of_node = nodes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of_node.join(least, "component").select("fp", "docs", "component_id")
    return join_counted(prints, named, ["fp"], "docs", prints.count()).select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
