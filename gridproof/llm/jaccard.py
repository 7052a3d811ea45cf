"""Near duplicates by the Jaccard similarity of word shingles: fast similarity sketching, banding, and exact verification.

A sketch has COORDINATES places. In round i every shingle of a text is thrown into a bin by a hash of its own; a bin keeps its least value, and values of a
later round are greater than all of an earlier one, so later rounds only fill bins that are still empty. From round COORDINATES on each
round fills one bin by all shingles, so every place of every text is filled. A text with many shingles is done after one or two
rounds. Two texts agree in a place with the probability of their similarity, as closely concentrated as if each place had its own hash.

Sketches give band keys and one bit a place. Texts that meet in a band, and whose sizes and bits allow the similarity asked for, are linked as candidates (a forest
a bucket, no pairs). Each group of candidates then gets its whole shingle sets, each moved once, and all members that are
still apart are compared exactly by the postings of their shingles; groups too large for a task are compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from .buckets import dealt, forest, hot_limit, join_counted, whole_buckets
from .components import connected_components
from .simhash import near_edges

SHINGLE = 5
LEAST = (4, 5)  # a similarity of 4/5 or more links
BANDS, ROWS = 32, 6  # a pair at 0.8 meets in no band with probability (1 - 0.8**6)**32, under 1 in 10,000
COORDINATES = BANDS * ROWS
FAR = 41  # differing bits of 192 (19.2 expected at 0.8, standard deviation 4.2: under 1 in 100,000 pairs has more)
MEMO_WORDS = 50_000
BATCH = 1 << 16  # shingles that are sketched at once
BUCKET = 8192  # rows of a band's bucket in a task
GROUP = 1 << 20  # shingles of a group of candidates in a task, twice where blocks meet

_NONE = np.iinfo(np.uint64).max
_SEEDS = np.random.default_rng(42).integers(0, 1 << 63, 2 * COORDINATES, np.uint64)


class _Words(dict):
    """Hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def shingles(text: str | bytes | None, memo: dict[bytes, int], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text (or its UTF-8 bytes); a text of fewer words is one shingle, one without words has none."""
    words = (text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n, k = max(1, len(words) - size + 1), min(size, len(words))
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = _mixed(h ^ each[i : i + n]) + np.uint64(i)
    return np.unique(h)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The fast similarity sketch of each set, a row of COORDINATES values; the empty set's has _NONE everywhere."""
    out = np.full((len(sets), COORDINATES), _NONE, np.uint64)
    grams = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i, seed in enumerate(_SEEDS):
        if not len(grams):
            break
        for at in range(0, len(grams), BATCH):
            h, o = _mixed(grams[at : at + BATCH] ^ seed), owner[at : at + BATCH]
            place = (h >> np.uint64(32)) * np.uint64(COORDINATES) >> np.uint64(32) if i < COORDINATES else np.full(len(h), i - COORDINATES, np.uint64)
            np.minimum.at(out.reshape(-1), o * COORDINATES + place.astype(np.int64), h & np.uint64(0xFFFFFFFF) | np.uint64(i << 32))
        unfilled = (out == _NONE).any(1)[owner]
        grams, owner = grams[unfilled], owner[unfilled]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each sketch."""
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sketch), 1))
    for r in range(ROWS):
        keys = _mixed(keys ^ sketch[:, r::ROWS]) + np.uint64(1)
    return keys.view(np.int64)


def sketch_bits(sketch: np.ndarray) -> np.ndarray:
    """One bit of each place, as COORDINATES / 64 words a sketch."""
    return np.packbits((_mixed(sketch) >> np.uint64(63)).astype(bool), axis=1).view(np.int64)


def set_simhash(grams: np.ndarray) -> int:
    """64 bits: each is 1 if it is set in over half of the shingles."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(grams), 1 << 14):
        counts += np.unpackbits(grams[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(grams)).tobytes(), "big", signed=True)


def _set_hash(grams: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), "<i8").tolist()
    return a, b


def sketched(docs: DataFrame, size: int, prints: bool, id_col: str, text_col: str) -> DataFrame:
    """id, t (a hash of the text), h1 and h2 (of the shingle set), n, keys (null without words), b0 to b2, fp for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))

    def made(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        sketch, n = sketches(sets), np.array([len(s) for s in sets])
        hashes, bits = np.array([_set_hash(s) for s in sets], np.int64).reshape(-1, 2), sketch_bits(sketch)
        offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, mask=np.append(n == 0, False))
        keys = pa.ListArray.from_arrays(offsets, pa.array(band_keys(sketch).reshape(-1)))
        fp = [set_simhash(s) for s in sets] if prints else np.zeros(len(sets), np.int64)
        columns = {"id": batch.column("id"), "t": batch.column("t"), "h1": hashes[:, 0], "h2": hashes[:, 1], "n": n, "keys": keys, **{f"b{i}": bits[:, i] for i in range(3)}, "fp": fp}
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns.values()], list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in batches:  # texts are taken one by one, so that a batch of long ones is not held twice
            sets, first, grams = [], 0, 0
            for i, text in enumerate(batch.column("text")):
                sets.append(shingles(text.as_buffer().to_pybytes() if text.is_valid else None, memo, size))
                grams += len(sets[-1])
                if grams >= BATCH or i + 1 == batch.num_rows:
                    yield made(batch.slice(first, i + 1 - first), sets)
                    sets, first, grams = [], i + 1, 0

    return rows.mapInArrow(run, "id long, t long, h1 long, h2 long, n long, keys array<long>, b0 long, b1 long, b2 long, fp long")


def _may_link(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Sizes by which two sets can be similar enough."""
    return LEAST[1] * np.minimum(na, nb) >= LEAST[0] * np.maximum(na, nb)


def band_links(nodes: DataFrame, count: int) -> DataFrame:
    """a, b: candidate links of nodes (node, n, keys, b0 to b2) that meet in a band, a forest a bucket."""
    members = nodes.filter("keys IS NOT NULL").select(F.explode("keys").alias("key"), F.lit(True).alias("owner"), "node", F.col("n").cast("int").alias("n"), "b0", "b1", "b2")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, starts in whole_buckets(frames, ["key", "x", "y"]):
            node, n, bits = f["node"].to_numpy(), f["n"].to_numpy().astype(np.int64), f[["b0", "b1", "b2"]].to_numpy().view(np.uint64)
            out: list[np.ndarray] = []
            size = np.diff(starts)
            two = starts[:-1][size == 2]  # most buckets
            near = two[_may_link(n[two], n[two + 1]) & (np.bitwise_count(bits[two] ^ bits[two + 1]).sum(1) <= FAR)]
            out.append(np.stack([node[near], node[near + 1]], 1))
            for k in np.flatnonzero(size > 2).tolist():
                i, j = starts[k], starts[k + 1]
                own, m, w = node[i:j], n[i:j], bits[i:j]
                links = forest(j - i, j - i, lambda a, b: _may_link(m[a][:, None], m[b][None]) & (sum(np.bitwise_count(w[a, c][:, None] ^ w[b, c][None]).astype(np.int16) for c in range(3)) <= FAR))  # noqa: B023
                out.append(own[np.array(links, np.int64).reshape(-1, 2)])
            links = np.concatenate(out)
            yield pd.DataFrame({"a": links.min(1), "b": links.max(1)})

    met = dealt(members, "node", count * BANDS, BUCKET)
    return met.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInPandas(run, "a long, b long").distinct()


def print_links(nodes: DataFrame) -> DataFrame:
    """a, b: nodes with one SimHash fingerprint (fp), or with fingerprints in 3 bits of each other; one node stands for all with its fingerprint."""
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("of")), "prints")
    total = nodes.count()
    same = join_counted(nodes.select("fp", "node"), prints.filter("of > 1"), ["fp"], "of", total).filter("node <> first").selectExpr("first AS a", "node AS b")
    near = near_edges(prints.select("fp"))
    ends = near.join(prints.selectExpr("fp AS a", "first AS x"), "a").join(prints.selectExpr("fp AS b", "first AS y"), "b").selectExpr("x AS a", "y AS b")
    return same.unionByName(ends).selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()


def exact_links(sets: list[np.ndarray], label: np.ndarray, first: np.ndarray, inner: bool) -> list[tuple[int, int]]:
    """Links (places) that connect all similar sets whose labels differ; label is changed on the way.

    Sets of `first` are compared with the others, and with each other if `inner`. A set is held against all others at once by the postings of
    its shingles. The one that shares most shingles goes first; after that only sets outside its group need to look for others, as of two
    similar ones that are apart one at least is outside.
    """
    size = np.array([len(s) for s in sets])
    grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    begins = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    many = np.diff(np.append(begins, len(grams)))
    posting = np.repeat(np.arange(len(begins)), many)
    shared = (many > 1)[posting]  # the shingles that more than one set has
    by_set = np.argsort(owner[shared], kind="stable")
    mine, at = posting[shared][by_set], np.searchsorted(owner[shared][by_set], np.arange(len(sets) + 1))
    weight = np.bincount(owner[shared], many[posting[shared]], len(sets))
    links: list[tuple[int, int]] = []

    def look(i: int) -> None:
        p = mine[at[i] : at[i + 1]]
        if not len(p):
            return
        starts, lengths = begins[p], many[p]
        flat = np.repeat(starts - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
        both = np.bincount(owner[flat], minlength=len(sets))
        found = (LEAST[1] * both >= LEAST[0] * (size[i] + size - both)) & (label != label[i])
        if not inner:
            found &= first != first[i]
        elif not first[i]:
            found &= first
        roots, k = np.unique(label[found], return_index=True)
        links.extend((i, int(j)) for j in np.flatnonzero(found)[k])
        label[np.isin(label, roots)] = label[i]

    hub = int(weight.argmax())
    look(hub)
    for i in np.flatnonzero(label != label[hub]).tolist():
        if label[i] != label[hub]:
            look(i)
    return links


def _compared(rows: DataFrame) -> DataFrame:
    """a, b: exact links of rows (key, x, y, node, label, first, inner, grams), bucket by bucket."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, starts in whole_buckets(frames, ["key", "x", "y"]):
            out: list[tuple[int, int]] = []
            node, label, first, inner, data = (f[c].to_numpy() for c in ("node", "label", "first", "inner", "grams"))
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if j - i > 1 and (label[i:j] != label[i]).any():
                    sets = [np.frombuffer(g, np.uint64) for g in data[i:j]]
                    out += [(int(node[i + p]), int(node[i + q])) for p, q in exact_links(sets, label[i:j].copy(), first[i:j].astype(bool), bool(inner[i]))]
            links = np.array(out, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInPandas(run, "a long, b long")


def verified_links(sets: DataFrame) -> DataFrame:
    """a, b: links that connect all similar ones of sets (node, key: its group of candidates, n, grams).

    A group of up to GROUP shingles is compared in one task. A larger one is dealt to blocks: first each block by itself and against block 0; then, if that
    leaves its members in several parts, what is outside its largest part, in blocks, against all other blocks. So each set moves a
    few times where most of a group is alike, and nothing is left out where it is not.
    """
    weights = sets.groupBy("key").agg(F.sum("n").alias("w"), F.count("*").alias("members"))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = hot_limit(total, GROUP)
    large = written(weights.filter(F.col("w") > limit).select("key", F.ceil(F.col("w") / limit).cast("int").alias("k")), "large")
    dealt_out = sets.join(F.broadcast(large), "key", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("x", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    own = dealt_out.select("key", "x", F.lit(0).alias("y"), "node", F.col("node").alias("label"), F.lit(True).alias("first"), F.lit(True).alias("inner"), "grams")
    if large.isEmpty():
        return _compared(own)
    hubs = dealt_out.filter("k > 1 AND x = 0").withColumn("x", F.explode(F.expr("sequence(1, k - 1)"))).select("key", "x", F.lit(0).alias("y"), "node", F.col("node").alias("label"), F.lit(False).alias("first"), F.lit(True).alias("inner"), "grams")
    links = written(_compared(own.unionByName(hubs)), "links")
    groups = connected_components(links).selectExpr("id AS node", "component AS label")
    named = written(sets.join(F.broadcast(large), "key").join(groups, "node", "left").withColumn("label", F.coalesce("label", "node")), "parts")
    parts = named.groupBy("key", "label").agg(F.sum("n").alias("w"))
    main = parts.groupBy("key").agg(F.max_by("label", "w").alias("main"), F.sum("w").alias("all"), F.max("w").alias("most"))
    apart = F.broadcast(main.filter("all > most").select("key", "main", F.ceil((F.col("all") - F.col("most")) / limit).cast("int").alias("kr")))  # as few as large groups
    rest = named.join(apart, "key").withColumn("outside", F.col("label") != F.col("main"))
    block = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    row = ["key", "x", "y", "node", "label", "first", F.lit(False).alias("inner"), "grams"]
    one = rest.filter("outside").withColumn("x", block("kr")).withColumn("y", F.explode(F.expr("sequence(0, k - 1)"))).withColumn("first", F.lit(True)).select(*row)
    other = rest.withColumn("y", block("k")).withColumn("x", F.explode(F.expr("sequence(0, kr - 1)"))).withColumn("first", F.lit(False)).select(*row)
    return links.unionByName(_compared(one.unionByName(other)))


def similar_edges(docs: DataFrame, nodes: DataFrame, size: int, prints: bool, text_col: str) -> DataFrame:
    """a, b: links between nodes (node, t, h1, h2, n, keys, b0 to b2, fp) that connect all similar ones that are candidates."""
    links = band_links(nodes, nodes.count())
    links = written(links.unionByName(print_links(nodes.filter("n > 0"))) if prints else links, "candidates")
    groups = written(connected_components(links).selectExpr("id AS node", "component AS key"), "groups")
    wanted = written(nodes.select("node", "t", "h1", "h2", "n").join(groups, "node"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, names = _Words(), ["h1", "h2", "grams"]
        out: list[tuple[int, int, bytes]] = []
        for batch in batches:
            for text in batch.column("text"):
                grams = shingles(text.as_buffer().to_pybytes() if text.is_valid else None, memo, size)
                out.append((*_set_hash(grams), grams.tobytes()))
                if len(out) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)

    texts = docs.select(F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).join(wanted.select("t").hint("merge"), "t", "left_semi").dropDuplicates(["t", "text"])  # texts move, at every size
    grams = texts.mapInArrow(run, "h1 long, h2 long, grams binary")  # one text stands for all with its set: its own hash names it
    sets = grams.join(wanted.drop("t"), ["h1", "h2"]).select("key", "node", "n", "grams")
    return verified_links(written(sets, "shingles"))


def similar_groups(docs: DataFrame, size: int = SHINGLE, prints: bool = False, link_empty: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id for every row: the smallest id reachable over texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

    Words are what stands between ASCII white space, in lower case for A-Z; a text of fewer words than a shingle has them all as its one. Equal sets are one node, so copies cost
    nothing. prints: candidates by SimHash and multi-index hashing too. Texts without words are alike, or, without link_empty, linked with nothing: each has its own id.
    Rows that repeat an id share its component. A null id links, but names a component only where it has no other id (then null).
    Texts are read whole, other columns are ignored, and an empty table gives an empty one.
    """
    rows = written(sketched(docs, size, prints, id_col, text_col), "sketches")
    linked = rows if link_empty else rows.filter("n > 0")
    first = [F.first(c).alias(c) for c in ("t", "n", "keys", "b0", "b1", "b2", "fp")]
    nodes = linked.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("docs"), *first).withColumn("node", F.monotonically_increasing_id())
    nodes = written(nodes, "nodes")  # numbered once
    edges = written(similar_edges(docs, nodes, size, prints, text_col), "links")
    ids = linked.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("a"), F.max(F.struct("h1", "h2")).alias("b"), F.count("*").alias("rows"))
    repeated = written(ids.filter("id IS NOT NULL AND a <> b").select("id", "rows"), "repeated")
    if not repeated.isEmpty():  # an id that repeats with different texts ties them together
        total = linked.count()
        tied = join_counted(linked.select("id", "h1", "h2"), repeated, ["id"], "rows", total).select("id", "h1", "h2").distinct().join(nodes.select("h1", "h2", "node"), ["h1", "h2"])
        least = tied.groupBy("id").agg(F.min("node").alias("a"), F.count("*").alias("rows"))
        edges = edges.unionByName(join_counted(tied.select("id", "node"), least, ["id"], "rows", total).selectExpr("a", "node AS b"))
    groups = connected_components(edges).withColumnRenamed("id", "node")
    of_node = written(nodes.select("node", "h1", "h2", "least", "docs").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "of-node")
    least = of_node.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    named = join_counted(of_node, least, ["component"], "nodes", of_node.count()).select("h1", "h2", "docs", "component_id")
    found = join_counted(linked.select("id", "n", "h1", "h2"), named, ["h1", "h2"], "docs", linked.count())
    columns = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"]
    return found.select(*columns) if link_empty else found.select(*columns).unionByName(rows.filter("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
