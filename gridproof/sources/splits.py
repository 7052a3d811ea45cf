"""Lines of text files by the splits in which Spark reads them: exact line numbers, and delimited records that begin in one split and end in another.

Spark cuts a large file at any byte and gives each split the lines that begin in it. What a line means may depend on all lines before it: its number does,
and in a delimited file whether it begins a record or goes on inside a quoted cell. Here a first pass tells of each split what it does to
that state, a running pass over the splits (a row each, not the lines) gives each split its state at the start, and a second pass
reads the lines with it. Files must not change between the passes.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

BROADCAST_SPLITS = 1_000_000
_SPLIT = ["file", "block"]


def split_lines(spark: SparkSession, path: str | list[str], pattern: str | None = None, line_end: str | None = None) -> DataFrame:
    """value, file, block (the place at which the split begins), line_id: all lines; ids of one split have no gaps and go as the lines do. Folders are searched below."""
    reader = spark.read.option("recursiveFileLookup", "true")
    for name, option in (("pathGlobFilter", pattern), ("lineSep", line_end)):
        reader = reader.option(name, option) if option else reader
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_id"))


def _with_splits(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """lines joined with what is known of their split; a broadcast, which leaves lines in order, or, beyond BROADCAST_SPLITS splits, a join that is sorted again."""
    if splits.count() <= BROADCAST_SPLITS:
        return lines.join(F.broadcast(splits), _SPLIT)
    return lines.join(splits.hint("merge"), _SPLIT).sortWithinPartitions(*_SPLIT, "line_id")


def number_lines(lines: DataFrame) -> DataFrame:
    """lines (of split_lines) with line: the number in the file, from 1, blank lines counted."""
    counts = lines.groupBy(*_SPLIT).agg(F.count("*").alias("n"), F.min("line_id").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    bases = written(counts.select(*_SPLIT, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "lines")
    return _with_splits(lines, bases).withColumn("line", F.col("base") + F.col("line_id") - F.col("first") + 1).drop("base", "first")


class _Ends:
    """Whether a record is open after a line, if it was (inside quotes) or was not before; quotes count as in Python's csv module: only at a cell's start."""

    def __init__(self, delimiter: str):
        d = re.escape(delimiter)
        inside, rest = r'(?:[^"]++|"")*+"(?!")', rf"[^{d}]*+"
        cell = rf'(?:"{inside}{rest}|[^"{d}]{rest}|)'
        self.whole = (re.compile(rf"{cell}(?:{d}{cell})*+\Z"), re.compile(rf"{inside}{rest}(?:{d}{cell})*+\Z"))

    def __call__(self, line: str, inside: bool) -> bool:
        return inside if '"' not in line else self.whole[inside].match(line) is None


def _split_states(lines: DataFrame, delimiter: str) -> DataFrame:
    """file, block, then0, then1, n0, n1: of each split, for both states at its start, the state at its end and how many records begin."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends, at, state, n = _Ends(delimiter), None, [False, True], [0, 0]
        row = lambda: pd.DataFrame([(*at, *map(int, state), *n)], columns=["file", "block", "then0", "then1", "n0", "n1"])
        for f in frames:
            for value, file, block in zip(f["value"], f["file"], f["block"]):
                if at != (file, block):
                    if at is not None:
                        yield row()
                    at, state, n = (file, block), [False, True], [0, 0]
                same = state[0] == state[1]
                for s in (0, 1):
                    n[s] += not state[s]
                    state[s] = ends(value, state[s]) if not (same and s) else state[0]
        if at is not None:
            yield row()

    return lines.select("value", *_SPLIT).mapInPandas(run, "file string, block long, then0 int, then1 int, n0 long, n1 long")


def _starts(states: DataFrame) -> DataFrame:
    """file, block, inside, base, open_row: how each split begins, records that begin before it, and the record that is open at its start.

    What a split does to the state is: set it, keep it, or turn it. So the state at a start is what the last split that set it left, turned as often as splits since then do.
    """
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = states.withColumn("turned", F.coalesce(F.sum(F.when((F.col("then0") == 1) & (F.col("then1") == 0), 1).otherwise(0)).over(order), F.lit(0)))
    left = F.when(F.col("then0") == F.col("then1"), F.struct("then0", "turned"))
    told = turns.withColumn("left", F.last(left, ignorenulls=True).over(before)).withColumn("passed", F.coalesce(F.max("turned").over(before), F.lit(0)))
    inside = told.withColumn("inside", (F.coalesce("left.then0", F.lit(0)) + F.col("passed") - F.coalesce("left.turned", F.lit(0))) % 2 == 1)
    return inside.withColumn("n", F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0"))).select(*_SPLIT, "inside", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_delimited_splits(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Cells (file, row, col, value) of UTF-8 delimited files, each read by as many tasks as it has splits; cell by cell what Python's csv module reads.

    Line ends inside quotes are part of a cell, doubled quotes are one, rows may be ragged, an empty line is a row without cells, a byte-order mark is
    left out. A quote that is never closed takes the rest of the file, without its last line end. Records that lie in several splits are put together by their row number; only these lines are shuffled.
    """
    lines = split_lines(spark, path, line_end="\n")
    known = _with_splits(lines, written(_starts(_split_states(lines, delimiter)), "splits"))

    def records(texts: Iterator[str]) -> Iterator[list[str]]:
        csv.field_size_limit(1 << 30)  # a cell may be long
        return csv.reader(texts, delimiter=delimiter)

    def read(edges: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ends, at, inside, row, held = _Ends(delimiter), None, False, 0, []  # held: lines of the open record
            whole = True  # whether the open record began in this split
            names = ["file", "block", "row", "text"] if edges else ["file", "row", "col", "value"]

            def cells(file: str, first: int, texts: list[str]) -> list[tuple]:
                return [(file, r, c, v) for r, record in enumerate(records(texts), first) for c, v in enumerate(record, 1)]

            for f in frames:
                out: list[tuple] = []
                texts, first = [], row + (not (held and whole))
                for value, file, block, begins, base in zip(f["value"], f["file"], f["block"], f["inside"], f["base"]):
                    if at != (file, block):
                        if at is not None:
                            out += [(*at, row, "".join(held))] if edges and held else [] if edges else cells(at[0], first, texts)
                        at, inside, row, held, whole = (file, block), bool(begins), int(base), [], not begins
                        texts, first = [], row + 1
                    row += not inside
                    whole |= not inside
                    inside = ends(value, inside)
                    held.append(value + "\n")
                    if not inside:
                        if edges and not whole:
                            out.append((*at, row, "".join(held)))
                        elif whole and not edges:
                            texts += held
                        held = []
                if at is not None and not edges:
                    out += cells(at[0], first, texts)
                yield pd.DataFrame(out, columns=names)
            if edges and held and at is not None:
                yield pd.DataFrame([(*at, row, "".join(held))], columns=names)

        return run

    def joined(f: pd.DataFrame) -> pd.DataFrame:
        ends, inside, text = _Ends(delimiter), False, "".join(f.sort_values("block")["text"])
        for line in text.split("\n")[:-1]:
            inside = ends(line, inside)
        text = text.removesuffix("\n") if inside else text
        found = [(f["file"].iloc[0], f["row"].iloc[0], c, v) for record in records(io.StringIO(text, newline="\n")) for c, v in enumerate(record, 1)]
        return pd.DataFrame(found, columns=["file", "row", "col", "value"])

    schema = "file string, row long, col int, value string"
    inner = known.select("value", *_SPLIT, "inside", "base").mapInPandas(read(False), schema)
    parts = known.select("value", *_SPLIT, "inside", "base").mapInPandas(read(True), "file string, block long, row long, text string")
    return inner.unionByName(parts.groupBy("file", "row").applyInPandas(joined, schema))
