"""The canonical table of a stream: batches that run twice, failures between write and commit, restarts, compaction."""

import json
import random

import pytest

from gridproof.streaming.canonical import CanonicalTable


def attempts(n, seed):
    rng = random.Random(seed)
    return [{"id": f"q{rng.randrange(40)}", "line": seed * 1000 + i, "status": rng.choice(["success", "run_failed"]), "answer": rng.choice(["42", "", " ", None, "x"])} for i in range(n)]


def canonical(rows):
    best, n = {}, {}
    for r in rows:
        key = (r["status"] == "success" and bool((r["answer"] or "").strip()), r["line"])
        n[r["id"]] = n.get(r["id"], 0) + 1
        if r["id"] not in best or key > best[r["id"]][0]:
            best[r["id"]] = (key, r)
    return sorted((i, r["line"], r["status"], r["answer"], n[i]) for i, (_, r) in best.items())


def put(folder, name, rows):
    text = "\n".join(json.dumps(r) for r in rows) + "\nno json\n[1]\n{}\n"
    (folder / f".{name}").write_text(text)
    (folder / f".{name}").rename(folder / name)


def got(table):
    return sorted(tuple(r) for r in table.read().collect())


def run(table, log, checkpoint):
    q = table.start(str(log), str(checkpoint), files_a_batch=1)
    try:
        q.awaitTermination(120)
        if q.exception():
            raise q.exception()
    finally:
        q.stop()


def test_a_restart_goes_on_and_nothing_counts_twice(spark, tmp_path):
    log, rows = tmp_path / "log", []
    log.mkdir()
    table = CanonicalTable(spark, str(tmp_path / "table"))
    assert got(table) == []
    for k in range(3):
        rows += attempts(50, k)
        put(log, f"{k}.jsonl", attempts(50, k))
    run(table, log, tmp_path / "checkpoint")
    assert got(table) == canonical(rows)
    plain, calls = CanonicalTable.upsert, []

    class Failing(CanonicalTable):
        def upsert(self, batch, number):
            plain(self, batch, number)
            calls.append(number)
            if len(calls) == 2:
                raise RuntimeError("lost after the write, before the commit")

    for k in range(3, 6):
        rows += attempts(50, k)
        put(log, f"{k}.jsonl", attempts(50, k))
    with pytest.raises(Exception, match="lost after the write"):
        run(Failing(spark, table.path), log, tmp_path / "checkpoint")
    assert got(table) == canonical(rows[:250])  # two of three
    again = Failing(spark, table.path)
    run(again, log, tmp_path / "checkpoint")
    assert calls[2] == calls[1] and len(calls) == 4  # the lost batch ran again
    assert got(table) == canonical(rows)


def test_replayed_batches_and_compaction(spark, tmp_path):
    table = CanonicalTable(spark, str(tmp_path))
    schema = "id string, line long, status string, answer string"
    batches = [[tuple(r.values()) for r in attempts(60, k)] for k in range(4)]
    for k, b in enumerate(batches):
        for _ in range(2):
            table.upsert(spark.createDataFrame(b, schema), k)
    every = [dict(zip(("id", "line", "status", "answer"), r)) for b in batches for r in b]
    assert got(table) == canonical(every)
    assert table.compact() == 3 and got(table) == canonical(every)
    more = attempts(30, 9)
    table.upsert(spark.createDataFrame([tuple(r.values()) for r in more], schema), 4)
    assert got(table) == canonical(every + more) and table.compact() == 4 and got(table) == canonical(every + more)
    done = {i for i, _, status, answer, _ in canonical(every + more) if status == "success" and (answer or "").strip()}
    ids = spark.createDataFrame([(f"q{i}",) for i in range(45)], "id string")
    assert {r.id for r in table.pending(ids).collect()} == {f"q{i}" for i in range(45)} - done
