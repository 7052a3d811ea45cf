"""Canonical predictions over an append-only log as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.parse import has_text


def canonical_stream(attempts: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """id, line, status, answer, attempts, emitted anew whenever a batch changes an id (update mode).

    State is one row an id: the last success with an answer, else the last attempt. With ttl_ms an id without new attempts for
    so long leaves the state, and a later attempt begins anew; without it state is kept, as the answer is that of the whole log. Attempts of one batch may come in any order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, n = (state.get[:4], state.get[4]) if state.exists else (None, 0)
        for f in frames:
            for line, status, answer in zip(f["line"], f["status"], f["answer"]):
                good = status == "success" and bool((answer or "").strip())
                if best is None or (good, line) > (bool(best[3]), best[0]):
                    best = (int(line), status, answer, good)
                n += 1
        state.update((*best, n))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([(key[0], best[0], best[1], best[2], n)], columns=["id", "line", "status", "answer", "attempts"])

    return attempts.groupBy("id").applyInPandasWithState(
        step, "id string, line long, status string, answer string, attempts long", "line long, status string, answer string, good boolean, attempts long", "update", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )


def attempts_of(lines: DataFrame, value: str = "value") -> DataFrame:
    """id, line, status, answer of JSON lines of a log; lines that are no objects with an id go."""
    row = F.try_parse_json(value)
    get = lambda name, kind="string": F.try_variant_get(row, f"$.{name}", kind).alias(name)
    return lines.select(get("id"), get("line", "long"), get("status"), get("answer")).filter("id IS NOT NULL")


def _merged(rows: DataFrame) -> DataFrame:
    """One row an id: its best attempt, and how many it had. Merging merged rows again changes nothing."""
    best = F.max_by(F.struct("line", "status", "answer", "good"), F.struct("good", "line"))  # a success with an answer first, then the later line
    return rows.groupBy("id").agg(best.alias("b"), F.sum("attempts").alias("attempts")).select("id", "b.line", "b.status", "b.answer", "b.good", "attempts")


class CanonicalTable:
    """Canonical predictions in a shared folder, kept up by a stream exactly once.

    Each batch writes what it adds to a folder named by its number, so a batch that runs again after a failure replaces what it wrote and nothing counts twice. The table
    is the merge of all batches; compact() merges those up to a number into a base, which counts once it is whole.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Sink of foreachBatch: the batch's attempts (id, line, status, answer), merged by id."""
        good = (F.col("status") == "success") & F.coalesce(has_text(F.col("answer")), F.lit(False))
        rows = batch.select("id", "line", "status", "answer", F.coalesce(good, F.lit(False)).alias("good"), F.lit(1).cast("long").alias("attempts"))
        _merged(rows).write.mode("overwrite").parquet(f"{self.path}/batches/batch={number}")

    def _folders(self, kind: str) -> list[int]:
        """Numbers of the whole folders of a kind, one a batch or base."""
        jvm = self.spark.sparkContext._jvm
        found = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/*/_SUCCESS")
        files = found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found)
        return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in files or [])

    def _rows(self) -> tuple[DataFrame | None, int | None]:
        base = max(self._folders("bases"), default=None)
        later = [n for n in self._folders("batches") if base is None or n > base]
        paths = [f"{self.path}/batches/batch={n}" for n in later] + ([f"{self.path}/bases/base={base}"] if base is not None else [])
        schema = "id string, line long, status string, answer string, good boolean, attempts long"
        return (self.spark.read.schema(schema).parquet(*paths) if paths else None), (later[-1] if later else base)

    def read(self) -> DataFrame:
        """id, line, status, answer, attempts: the answer of the whole log so far."""
        rows, _ = self._rows()
        if rows is None:
            return self.spark.createDataFrame([], "id string, line long, status string, answer string, attempts long")
        return _merged(rows).drop("good")

    def compact(self) -> int | None:
        """Merge all whole batches into a base and return its number; call it while no batch runs. Batches that it holds are not read any more."""
        rows, number = self._rows()
        if rows is not None:
            _merged(rows).write.mode("overwrite").parquet(f"{self.path}/bases/base={number}")
        return number

    def pending(self, ids: DataFrame) -> DataFrame:
        """The ids (id) without a success that has an answer: what a resumed run still has to do."""
        rows, _ = self._rows()
        return ids if rows is None else ids.join(_merged(rows).filter("good").select("id"), "id", "left_anti")

    def start(self, log: str, checkpoint: str, pattern: str = "*.jsonl", files_a_batch: int | None = None, **trigger) -> StreamingQuery:
        """Follow the JSON-lines files of a folder. Which files a batch has is in the checkpoint before it runs, so a restart repeats the last batch with the same files, or goes on after it."""
        reader = self.spark.readStream.schema("value string").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        reader = reader.option("maxFilesPerTrigger", str(files_a_batch)) if files_a_batch else reader
        attempts = attempts_of(reader.text(log))
        return attempts.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
