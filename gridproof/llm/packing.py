"""Best-fit packing of token sequences in bulk-synchronous rounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ._shared import new_path, written
from ._tokens import encoder

PIECES = "doc_id long, piece long, start long, length long, ids_crc32 long, row long"
SWEPT = "part long, kind string, rank long, row long, length long, sequence_id long, gap long, slot long"
HARMONIC = 4
SHORT = 8
ROWS_A_TASK = 200_000
BROADCAST_ROWS = 50_000  # documents that go to other ranges, 32 bytes each
SLOT = ["row", "length", "sequence_id", "gap", "slot"]
_TASK, _ROUND = 33, 54  # bits below the task in a row's number, and below the round in a sequence's


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", memo: int | None = None) -> DataFrame:
    """One row a piece, with a number of its own (row) once written. No shuffle. memo: pieces of texts whose ids a worker keeps."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, row = encoder(tokenizer_path, memo=memo), TaskContext.get().partitionId() << _TASK
        end = np.array([end_id], "<u4")
        for f in frames:
            rows = []
            for key, text in zip(f["id"].astype("Int64"), f["text"]):
                ids = np.concatenate([enc.ids(text).astype("<u4"), end])
                first = (len(ids) - 1) % capacity + 1  # only the first piece may be shorter
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((key, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), row))
                    row += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "row"])
            yield out.astype({"doc_id": "Int64"})

    return docs.selectExpr(f"cast(`{id_col}` as long) AS id", f"`{text_col}` AS text").mapInPandas(run, PIECES)


def bands(capacity: int) -> list[tuple[int, int]]:
    """(least - 1, most) lengths of each band, longest first: those of which 1, 2, ... HARMONIC fit in a sequence, and then down to half, and half of that."""
    tops = [capacity // n for n in range(1, HARMONIC + 2)]
    while tops[-1] > SHORT:
        tops.append(max(tops[-1] // 2, 1))
    tops = sorted({t for t in tops if t}, reverse=True)
    return list(zip([*tops[1:], 0], tops))


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Match one range of documents and gaps, in descending order: a document takes the smallest gap seen that is still free.

    What the range can't match goes on with its rank: documents met while no gap was free, and free gaps from the largest to the smallest. A
    last row has the numbers of matches (row), documents (rank) and gaps (slot).
    """
    part, waiting, matched, free = TaskContext.get().partitionId(), 0, 0, []
    columns = [x.split()[0] for x in SWEPT.split(", ")]
    for f in frames:
        rows = []
        for length, row, sequence, gap, slot in zip(f["length"].tolist(), f["row"].tolist(), f["sequence_id"].tolist(), f["gap"].tolist(), f["slot"].tolist()):
            if not length:
                free.append((sequence, gap, slot))
            elif free:
                rows.append((part, "match", 0, row, length, *free.pop()))
            else:
                rows.append((part, "document", waiting, row, length, 0, 0, 0))
                waiting += 1
        matched += sum(r[1] == "match" for r in rows)
        yield pd.DataFrame(rows, columns=columns)
    rows = [(part, "gap", i, -1, 0, *x) for i, x in enumerate(free)]
    yield pd.DataFrame([*rows, (part, "count", waiting, matched, 0, 0, 0, len(free))], columns=columns)


def _across(counts: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """How the ranges' leftovers meet, from (range, documents, gaps): matches (range, first rank, last rank + 1, range of the gaps, sum of both
    ranks), and (range, first rank left, number of the documents left in ranges before)."""
    free: list[list[int]] = []
    met, left, before = [], [], 0
    for part, documents, gaps in sorted(counts):
        rank = 0
        while rank < documents and free:
            q, n = free[-1]
            take = min(n, documents - rank)
            met.append((part, rank, rank + take, q, n - 1 + rank))
            rank += take
            free[-1][1] -= take
            if not free[-1][1]:
                free.pop()
        if rank < documents:
            left.append((part, rank, before))
            before += documents - rank
        if gaps:
            free.append([part, gaps])
    return met, left


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Place pieces (the columns of PIECES; row is unique and stays when read again) in sequences of `capacity` tokens by best fit.

    Adds sequence_id and offset; sequences have no gaps from 0 on. Documents go in bands of lengths, the longest first. Those over
    half the capacity open a sequence each. In a round of a lower band its documents and the gaps that can take one are sorted by
    size into ranges, so a hot length is spread over several. Each range is swept in descending order: a document takes
    its successor, the smallest gap that is free and long enough. What a range can't match is ranked, and meets
    the leftovers of the ranges of larger sizes, the nearest first, by these ranks; only the counts of the ranges go over the
    driver. A gap that can take several of any length in the band has as many places. Gaps are updated and rounds
    repeated until all documents are placed or no gap can take one any more; those left open new sequences in the order of their ranks. An
    empty table gives an empty table.
    """
    spark = pieces.sparkSession
    placed_path = new_path(spark, "placed")
    tops = [hi for _, hi in bands(capacity)]
    band = F.lit(0)
    for i, hi in enumerate(tops):
        band = F.when(F.col("length") <= hi, F.lit(i)).otherwise(band)
    alone = F.col("length") > capacity // 2
    first = pieces.filter(alone)
    first.select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).write.parquet(f"{placed_path}/round=0")
    short = written(pieces.filter(~alone).select("row", "length", band.alias("band")), "short")
    gaps = first.filter(F.col("length") < capacity).select(F.col("row").alias("sequence_id"), (F.lit(capacity) - F.col("length")).cast("long").alias("gap"))
    todo = {r["band"]: r["n"] for r in short.groupBy("band").agg(F.count("*").alias("n")).collect()}  # a row a band
    swept: DataFrame | None = None
    free, widest, rounds, zero = sum(todo.values()), capacity - capacity // 2 - 1, 0, F.lit(0).cast("long")
    for i, n in sorted(todo.items()):
        low, top = bands(capacity)[i]
        documents = short.filter(F.col("band") == i).select("row", "length")
        while n:
            rounds += 1
            slots = gaps.filter(F.col("gap") > low).withColumn("slot", F.explode(F.sequence(F.lit(1), F.greatest(F.floor(F.col("gap") / top), F.lit(1)).cast("long"))))
            events = slots.select(F.col("gap").alias("size"), zero.alias("row"), zero.alias("length"), "sequence_id", "gap", "slot").unionByName(
                documents.select(F.col("length").alias("size"), "row", "length", zero.alias("sequence_id"), zero.alias("gap"), zero.alias("slot"))
            )
            # gaps come before documents of their size; the hash parts rows of one size
            order = [F.desc("size"), F.asc("length"), F.xxhash64("row", "sequence_id", "slot")]
            swept = written(events.repartitionByRange(max(1, (n + free) // ROWS_A_TASK), *order).sortWithinPartitions(*order).mapInPandas(_sweep, SWEPT), "swept", swept)
            counts = swept.filter("kind = 'count'").select("part", F.col("row").alias("matches"), F.col("rank").alias("documents"), F.col("slot").alias("gaps")).collect()  # a row a range
            met, left = _across([(r["part"], r["documents"], r["gaps"]) for r in counts])
            across = sum(high - first for _, first, high, _, _ in met)
            found = across + sum(r["matches"] for r in counts)
            waiting = swept.filter("kind = 'document'").select("part", "rank", "row", "length")
            rest = swept.filter("kind = 'gap'")
            if met:
                ways = spark.createDataFrame(met, "part long, low long, high long, to long, sum long")  # two a range at most
                sent = waiting.join(F.broadcast(ways), "part").filter("rank >= low AND rank < high").select(F.col("to").alias("part"), (F.col("sum") - F.col("rank")).alias("rank"), F.col("row").alias("in_row"), F.col("length").alias("in_length"))
                sent = F.broadcast(sent) if across <= BROADCAST_ROWS else sent
                rest = rest.join(sent, ["part", "rank"], "left").withColumns({"row": F.coalesce("in_row", "row"), "length": F.coalesce("in_length", "length")})
            placed = swept.filter("kind = 'match'").select(*SLOT).unionByName(rest.select(*SLOT))
            unmatched = spark.createDataFrame(left, "part long, first long, before long")
            waiting = waiting.join(F.broadcast(unmatched), "part").filter("rank >= first").select("part", "row", "length", (F.col("before") + F.col("rank") - F.col("first")).alias("rank"))
            n -= found
            if n and (not found or widest - (low + 1) <= low):  # a gap that took one can't take another, and the free ones are too small
                placed = placed.unionByName(_opened(waiting, low, top, capacity, rounds))
                free, n = free + n, 0
            mine = Window.partitionBy("sequence_id").orderBy("slot")
            before = F.coalesce(F.sum("length").over(mine.rowsBetween(Window.unboundedPreceding, -1)), zero)
            last = F.lead("slot").over(mine).isNull()
            state = placed.select(*SLOT, (F.lit(capacity) - F.col("gap") + before).alias("offset"), F.when(last, F.col("gap") - before - F.col("length")).alias("left"))
            seen = Observation()
            state.observe(seen, F.max("left").alias("widest")).write.parquet(f"{placed_path}/round={rounds}")
            widest = max(low, seen.get["widest"] or 0)  # gaps that this band can't use stay as they are
            after = spark.read.schema(state.schema).parquet(f"{placed_path}/round={rounds}").filter("left > 0").select("sequence_id", F.col("left").alias("gap"))
            gaps = gaps.filter(F.col("gap") <= low).unionByName(after)
            documents = waiting.select("row", "length")
    placed = spark.read.schema("row long, sequence_id long, offset long").option("recursiveFileLookup", "true").parquet(placed_path).filter("row >= 0")
    return pieces.join(placed, "row").select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


def _opened(waiting: DataFrame, low: int, top: int, capacity: int, rounds: int) -> DataFrame:
    """New sequences for what waits, taken by rank: as many each as any of the band fit, or as the sum of their lengths allows."""
    if capacity // (low + 1) == capacity // top:
        number = F.floor(F.col("rank") / (capacity // top))
    else:  # a sequence begins with the first document after each multiple of capacity - top, and so ends in time
        sums = waiting.groupBy("part").agg(F.sum("length").alias("all"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
        bases = sums.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
        inside = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        waiting = waiting.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.coalesce(F.sum("length").over(inside), F.lit(0)))
        number = F.floor(F.col("start") / (capacity - top))
    return waiting.select("row", "length", (F.lit(rounds << _ROUND) + number.cast("long")).alias("sequence_id"), F.lit(capacity).cast("long").alias("gap"), F.col("rank").alias("slot"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", memo: int | None = None) -> DataFrame:
    """Encode, cut and pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece with the end id alone. Null ids and repeated rows are packed like others, one set
    of pieces a row. Only texts over `capacity` tokens are cut, into pieces of `capacity`; the first may be shorter.
    Pieces are written to the shared folder once, so texts are encoded once. Columns other than these two are ignored.
    """
    return pack(written(cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, memo), "pieces"), capacity)
