"""Whitening of embeddings against numpy, and hard cases."""

import math

import numpy as np
import pytest

from gridproof.llm import whitening
from gridproof.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, k=8):
    x = np.floor(1024 * np.asarray(vectors, float)).astype(np.int64) + 100000
    n, sums = len(x), x.sum(0)
    y = x - sums / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return y @ u / np.sqrt(e), ((n * x - sums) ** 2).sum(1), e / np.trace(v)


def compare(rows, ids, vectors, k=8):
    w, deviation, explained = brute(vectors, k)
    at = {i: p for p, i in enumerate(ids)}
    assert len(rows) == len(ids) * w.shape[1]
    signs = {}
    for r in rows:
        p, c = at[r.vec_id], r.component - 1
        assert r.n == len(ids) and r.deviation == int(deviation[p]) and math.isclose(r.explained, explained[c], rel_tol=1e-9) and r.identity_error < 1e-9
        signs.setdefault(c, set()).add(round(r.whitened / w[p, c]) if abs(w[p, c]) > 1e-3 else None)
        assert abs(abs(r.whitened) - abs(w[p, c])) < 1e-8
    assert all(len(s - {None}) == 1 for s in signs.values())  # one sign for all rows of a component


def test_op13(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    compare(QUERIES["op13_whitening"](spark, DATA).collect(), [r.vec_id for r in table], [r.embedding for r in table])


def test_unusable_vectors_are_left_out(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(0, [3, 2, 1, 0.5], (60, 4)).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(good)]
    bad = [None, [], [1.0, None, 0.0, 0.0], [float("nan"), 0.0, 0.0, 0.0], [0.0, float("inf"), 0.0, 0.0], [0.0, 0.0, -math.inf, 0.0], [1.0, 2.0]]
    docs = spark.createDataFrame([*rows, *[(1000 + i, v, None) for i, v in enumerate(bad)]], SCHEMA)
    compare(whitening.whiten(docs).collect(), [r[0] for r in rows], good)
    clash = docs.selectExpr("*", "1 AS wh_x", "2 AS component", "3 AS n", "4 AS deviation", "5 AS part")
    compare(whitening.whiten(clash).collect(), [r[0] for r in rows], good)


def test_null_and_repeated_ids_and_equal_rows_each_count(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(20, 3)).astype(np.float32)
    data = [(None, v[0].tolist(), 1), (None, v[0].tolist(), 1), *[(7, x.tolist(), 1) for x in v]]
    got = whitening.whiten(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == 22 * 3 and {r.n for r in got} == {22} and sum(r.vec_id is None for r in got) == 6


def test_no_variance_and_empty(spark):
    for data in ([], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(5)], [(1, None, 0)]):
        got = whitening.whiten(spark.createDataFrame(data, SCHEMA))
        assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = [(i, [float(i), 2.0], 0) for i in range(9)]  # the second dimension does not vary
    assert {r.component for r in whitening.whiten(spark.createDataFrame(one, SCHEMA)).collect()} == {1}


def test_large_entries_add_up_exactly(spark):
    v = [[2.0**39, 1.0], [-(2.0**39), 0.0], [3.0, 2.0**38]] * 4
    docs = spark.createDataFrame([(i, x, 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    x = [[math.floor(1024 * c) + 100000 for c in row] for row in v]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(docs).collect()}
    assert got == {i: sum((n * c - s) ** 2 for c, s in zip(row, sums)) for i, row in enumerate(x)}
    with pytest.raises(ValueError, match="beyond"):
        whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<double>"))


def test_pairs_in_several_aggregations(spark, monkeypatch):
    monkeypatch.setattr(whitening, "EXPRESSIONS", 4)
    v = np.random.default_rng(8).normal(size=(50, 5)).astype(np.float32)
    compare(whitening.whiten(spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], SCHEMA), 3).collect(), list(range(50)), v, 3)
