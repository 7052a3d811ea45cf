"""Token-id output: raw binary shards of ids, and a minimal perfect hash index from document keys to shard offsets.

Files under one folder: shards/*.bin (16 bytes of header: magic, item size; then ids, little-endian), locations/
(Parquet, one row a document, in shard order), shard_list/ (Parquet: shard, file, ids, base), header/ (Parquet, one row: the number
of buckets) and index/ (Parquet, in a folder for each BUCKETS_A_PART buckets, one row a bucket of keys: the levels of the hash, and for each
slot a fingerprint, shard, offset and length). The bucket of a key is known from the key, so a lookup reads one row of one folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tokens import encoder

MAGIC = b"TOKENIDS"
HEADER = 16
BUCKET_KEYS = 4096
BUCKETS_A_PART = 256
INDEX = "bucket long, sizes binary, bits binary, rest binary, prints binary, shard binary, offset binary, n_ids binary, twins binary, part long"
GAMMA = 2.0
LEVELS = 24
_NULL_KEY = np.uint64(0x9E3779B97F4A7C15)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def key_hash(ids: pd.Series, copies: pd.Series) -> np.ndarray:
    """64 bits for (doc_id, copy); a null id has a constant of its own."""
    null = ids.isna().to_numpy()
    h = _mix(ids.fillna(0).astype("int64").to_numpy().view(np.uint64))
    h[null] = _NULL_KEY
    with np.errstate(over="ignore"):
        return _mix(h + copies.to_numpy().astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _level(h: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(h + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)


def build_mph(h: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes and bits of the levels of a minimal perfect hash, and the (few) keys left after the last level."""
    sizes, bits = [], []
    for level in range(LEVELS):
        if not len(h):
            break
        size = -(-max(8, int(GAMMA * len(h))) // 8) * 8
        at = _level(h, level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        h = h[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.empty(0, bool), np.sort(h)


def mph_slots(h: np.ndarray, sizes: list[int], bits: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Slot of each key; a key that is not in the set gets any slot or -1."""
    rank = np.cumsum(bits) - bits
    slot, todo, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    for level, size in enumerate(sizes):
        at = base + _level(h[todo], level, size)
        hit = bits[at]
        slot[todo[hit]] = rank[at[hit]]
        todo, base = todo[~hit], base + size
    if len(todo) and len(rest):
        at = np.searchsorted(rest, h[todo])
        ok = (at < len(rest)) & (rest[np.minimum(at, len(rest) - 1)] == h[todo])
        slot[todo[ok]] = int(bits.sum()) + at[ok]
    return slot


def _find(keys: pd.DataFrame, row) -> pd.DataFrame:
    """doc_id, copy, shard, offset, n_ids of the keys that a bucket's row has; others drop out by their fingerprints."""
    h = key_hash(keys["doc_id"], keys["copy"])
    sizes = np.frombuffer(row["sizes"], "<i8").tolist()
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(sizes)].astype(bool)
    slot = mph_slots(h, sizes, bits, np.frombuffer(row["rest"], "<u8"))
    prints = np.frombuffer(row["prints"], "<u4")
    at = np.minimum(np.maximum(slot, 0), max(0, len(prints) - 1))
    ok = (slot >= 0) & (prints[at] == (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)) if len(prints) else np.zeros(len(h), bool)
    places = np.stack([np.frombuffer(row[c], "<i8")[slot[ok]] for c in ("shard", "offset", "n_ids")], 1)
    found = keys.loc[ok, ["doc_id", "copy"]]
    twins = np.frombuffer(row["twins"], "<i8").reshape(-1, 6)
    if len(twins):  # keys of one hash are stored as they are
        known = {(None if t[0] else t[1], t[2]): t[3:] for t in twins.tolist()}
        also = [known.get((None if pd.isna(k) else int(k), int(c))) for k, c in zip(keys["doc_id"], keys["copy"])]
        more = np.array([x is not None for x in also], bool)
        places = np.concatenate([places, np.array([x for x in also if x is not None], np.int64).reshape(-1, 3)])
        found = pd.concat([found, keys.loc[more, ["doc_id", "copy"]]])
    return found.assign(shard=places[:, 0], offset=places[:, 1], n_ids=places[:, 2])


class TokenStore:
    """Shards and index in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.locations = spark.read.parquet(f"{path}/locations")
        self.shards = spark.read.parquet(f"{path}/shard_list")
        self.index = spark.read.schema(INDEX).parquet(f"{path}/index")
        self.buckets = int(spark.read.parquet(f"{path}/header").first()["buckets"])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """doc_id, copy, shard, offset, n_ids of the given (doc_id, copy), a large set; keys that are not indexed drop out by fingerprint."""
        n = self.buckets

        def bucketed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                f["bucket"] = _bucket(key_hash(f["doc_id"], f["copy"]), n)
                yield f

        def find(keys: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(keys):
                return pd.DataFrame({"doc_id": [], "copy": [], "shard": [], "offset": [], "n_ids": []})
            return _find(keys, rows.iloc[0])

        keyed = keys.select("doc_id", "copy").mapInPandas(bucketed, "doc_id long, copy long, bucket long")
        return keyed.groupBy("bucket").cogroup(self.index.groupBy("bucket")).applyInPandas(find, "doc_id long, copy long, shard long, offset long, n_ids long")

    def bucket_row(self, bucket: int) -> DataFrame:
        """The index row of one bucket: its part's folder is the only one listed in the scan, and statistics lead to its row."""
        return self.index.filter((F.col("part") == bucket // BUCKETS_A_PART) & (F.col("bucket") == bucket))

    def place(self, doc_id: int | None, copy: int = 0) -> dict | None:
        """shard, offset and n_ids of one document, from one row of the index."""
        key = pd.DataFrame({"doc_id": pd.Series([doc_id], dtype="Int64"), "copy": [copy]})
        row = self.bucket_row(int(_bucket(key_hash(key["doc_id"], key["copy"]), self.buckets)[0])).first()
        found = _find(key, row) if row else ()
        return found.iloc[0].to_dict() if len(found) else None

    def read(self, places: DataFrame) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32, read from the shards in the order of their offsets."""
        placed = places.join(self.shards, "shard").repartition("shard").sortWithinPartitions("shard", "offset")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            name, file = None, None
            for f in frames:
                crcs = []
                for uri, at, n in zip(f["file"], f["offset"], f["n_ids"]):
                    if uri != name:
                        if file is not None:
                            file.close()
                        system, path = _filesystem(uri)
                        name, file = uri, system.open_input_file(path)
                        head = file.read_at(HEADER, 0)
                        if head[:8] != MAGIC:
                            raise ValueError(f"{uri} is no token shard")
                        width = head[8]
                    ids = np.frombuffer(file.read_at(n * width, HEADER + at * width), f"<u{width}")
                    if len(ids) != n:
                        raise ValueError(f"{uri} ends before id {at + n}")
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pd.DataFrame({"doc_id": f["doc_id"], "copy": f["copy"], "start": f["base"] + f["offset"], "n_tokens": f["n_ids"], "ids_crc32": crcs})
            if file is not None:
                file.close()

        return placed.mapInPandas(run, "doc_id long, copy long, start long, n_tokens long, ids_crc32 long")

    def get(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        """The ids of one document: one index row, one hash, one ranged read."""
        place = self.place(doc_id, copy)
        if place is None:
            return None
        system, path = _filesystem(self.shards.filter(F.col("shard") == int(place["shard"])).first()["file"])
        with system.open_input_file(path) as file:
            width = file.read_at(HEADER, 0)[8]
            return np.frombuffer(file.read_at(int(place["n_ids"]) * width, HEADER + int(place["offset"]) * width), f"<u{width}")


def _numbered(places: DataFrame) -> DataFrame:
    """Copies numbered through: where rows of one id go on in the next shard, those of the shards before count too.

    Only the first and last ids of shards can do so: at most two rows a shard.
    """
    edges = places.groupBy("shard").agg(F.array(F.min_by("doc_id", "offset"), F.max_by("doc_id", "offset")).alias("ids"))
    split = edges.select("shard", F.explode(F.array_distinct("ids")).alias("id")).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    each = places.join(F.broadcast(split), F.col("doc_id").eqNullSafe(F.col("id"))).groupBy("id", F.col("shard").alias("in_shard")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("id").orderBy("in_shard").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("id", "in_shard", F.sum("n").over(before).alias("base")).filter("base > 0")
    joined = places.join(F.broadcast(base), (F.col("shard") == F.col("in_shard")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return joined.withColumn("copy", F.col("copy") + F.coalesce("base", F.lit(0).cast("long"))).select(*places.columns)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
    """Encode all documents in ascending order of their ids (nulls first), write shards and index under path.

    Texts are sorted by range before they are encoded, so one shuffle of the texts is all that moves. A null or empty
    text is the end id alone. Rows with one id are numbered (copy 0, 1, ...) and all kept, over several ranges if they are many; a null id is a key
    like any other. Each attempt of a task writes a file of its own, and only files named in the committed locations
    count, so lost executors and repeated tasks do no harm. An empty table gives a store without rows. Other columns are ignored.
    """
    spark = docs.sparkSession

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, task = encoder(tokenizer_path), TaskContext.get()
        shard, uri = task.partitionId(), f"{path}/shards/{task.partitionId():08d}-{task.taskAttemptId()}.bin"
        out, at, last, copy = None, 0, object(), 0
        end = np.array([end_id], enc.dtype)
        for f in frames:
            if out is None:
                system, where = _filesystem(uri)
                system.create_dir(where.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(where)
                out.write(MAGIC + bytes([end.itemsize]) + bytes(HEADER - len(MAGIC) - 1))
            copies, offsets, lengths = [], [], []
            ids = f["id"].astype("Int64")
            for key, text in zip(ids, f["text"]):
                got = np.concatenate([enc.ids(text), end])
                out.write(got.tobytes())
                key = None if key is pd.NA else key
                copy, last = (copy + 1 if key == last else 0), key
                copies.append(copy)
                offsets.append(at)
                lengths.append(len(got))
                at += len(got)
            yield pd.DataFrame({"doc_id": ids, "copy": copies, "shard": shard, "file": uri, "offset": offsets, "n_ids": lengths})
        if out is not None:
            out.close()

    rows = docs.selectExpr(f"cast(`{id_col}` as long) AS id", f"`{text_col}` AS text").withColumn("tie", F.monotonically_increasing_id())  # parts the rows of one id
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    locations = "doc_id long, copy long, shard long, file string, offset long, n_ids long"
    ordered.mapInPandas(write, locations).write.parquet(f"{path}/encoded")
    _numbered(spark.read.schema(locations).parquet(f"{path}/encoded")).write.parquet(f"{path}/locations")
    places = spark.read.schema(locations).parquet(f"{path}/locations")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = places.groupBy("shard", "file").agg(F.sum("n_ids").alias("ids"))
    sums.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long"))).write.parquet(f"{path}/shard_list")  # one row a shard
    buckets = max(1, -(-places.count() // BUCKET_KEYS))

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            h = key_hash(f["doc_id"], f["copy"])
            yield f.assign(bucket=_bucket(h, buckets), h=h.view(np.int64))

    def build(f: pd.DataFrame) -> pd.DataFrame:
        h, bucket = f["h"].to_numpy().view(np.uint64), int(f["bucket"].iloc[0])
        twin = f["h"].duplicated(keep=False).to_numpy()
        null = f["doc_id"].isna()
        twins = np.stack([x[twin].astype("<i8") for x in (null.to_numpy(), f["doc_id"].fillna(0).to_numpy(), *[f[c].to_numpy() for c in ("copy", "shard", "offset", "n_ids")])], 1)
        f, h = f[~twin], h[~twin]
        sizes, bits, rest = build_mph(h)
        order = np.empty(len(h), np.int64)
        order[mph_slots(h, sizes, bits, rest)] = np.arange(len(h))
        column = lambda name: f[name].to_numpy().astype("<i8")[order].tobytes()
        prints = (h & np.uint64(0xFFFFFFFF)).astype("<u4")[order].tobytes()
        row = (bucket, np.array(sizes, "<i8").tobytes(), np.packbits(bits).tobytes(), rest.astype("<u8").tobytes(), prints, column("shard"), column("offset"), column("n_ids"), twins.tobytes(), bucket // BUCKETS_A_PART)
        return pd.DataFrame([row])

    keys = places.select("doc_id", "copy", "shard", "offset", "n_ids").mapInPandas(keyed, "doc_id long, copy long, shard long, offset long, n_ids long, bucket long, h long")
    index = keys.groupBy("bucket").applyInPandas(build, INDEX)
    index.repartition("part").sortWithinPartitions("part", "bucket").write.partitionBy("part").parquet(f"{path}/index")
    spark.range(1).select(F.lit(buckets).cast("long").alias("buckets")).write.parquet(f"{path}/header")
    return TokenStore(spark, path)
