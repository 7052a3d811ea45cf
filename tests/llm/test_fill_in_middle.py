"""Fill-in-the-middle: lists of boundaries, cuts against brute force, hard cases."""

import hashlib

import duckdb
import numpy as np
import pytest

from gridproof.llm import fill_in_middle as fim
from gridproof.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def brute(doc_id, text, seed="1"):
    t = text or ""
    s = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(s[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [5], list(range(10000)), [3 * i * i for i in range(3000)], [0] * 9000 + [10**9], sorted(np.random.default_rng(1).integers(0, 1 << 40, 5000).tolist())])
def test_elias_fano_selects_each_value(values):
    kept = fim.EliasFano.from_bytes(fim.EliasFano.of(np.array(values)).to_bytes())
    assert [kept.select(i) for i in range(0, len(values), 1 + len(values) // 500)] == values[:: 1 + len(values) // 500] and kept.select(len(values) - 1) == values[-1]
    for i in (-1, len(values)):
        with pytest.raises(IndexError):
            kept.select(i)


def test_list_takes_few_bits():
    text = ("é a" * 20000).encode()
    assert len(fim.EliasFano.of(fim.boundaries(text)).to_bytes()) * 8 < 3.2 * 60000


def test_hard_cases(spark):
    texts = ["", None, "a", "é", "𝄞x", "a<P>b", "x<S>", "<M>", "< P>", "line\nline\r\n", "é " * 50, "long text " * 30000, "same text here", "ends\x00in nul\x00"]
    rows = [(i * 17 + k, t, 1, 2) for k in range(12) for i, t in enumerate(texts)] + [(None, "no id", 1, 2), (None, None, 1, 2), (5, "one", 1, 2), (5, "one", 1, 2), (5, "two", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form long, fm_text long")
    got = fim.fill_in_middle(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute(r[0], r[1]) for r in rows), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    back = fim.fill_in_middle(docs).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
    assert sorted((repr(r.doc_id), r.back) for r in back) == sorted((repr(r[0]), r[1] or "") for r in rows)


def test_a_text_of_many_documents_goes_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(fim, "COPIES", 10)
    docs = spark.range(400).selectExpr("id AS doc_id", "if(id % 3 > 0, 'the one text of two thirds', concat('text ', id % 50)) AS text")
    made = fim.fill_in_middle(docs)
    assert sorted(map(tuple, made.collect()), key=repr) == sorted((brute(r.doc_id, r.text) for r in docs.collect()), key=repr)
    spread = fim.text_index(docs).filter("fm_copies > 10").select("fm_text", "fm_copies").collect()
    assert [(r.fm_text, r.fm_copies) for r in spread] == [("the one text of two thirds", 266)] or len(spread) > 1


def test_index_has_a_row_for_each_text(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["x", "x", None, "", "y"])], "doc_id long, text string")
    assert sorted((r.fm_text, r.fm_copies) for r in fim.text_index(docs).collect()) == [("", 2), ("x", 2), ("y", 1)]


def test_empty(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_op12(spark):
    got = {r.doc_id: r for r in QUERIES["op12_fill_in_middle"](spark, DATA).collect()}
    table = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(table)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    sql = {r[0]: r for r in con.sql(ORACLE_SQL["op12_fill_in_middle"]).fetchall()}
    for r in table:
        want = brute(r.doc_id, r.text)
        g = got[r.doc_id]
        assert (g.doc_id, g.n, g.form, g.prefix_chars, g.middle_chars, g.output_sha256, g.restored_sha256) == (*want[:5], sha(want[5]), sha(r.text or "")) == sql[r.doc_id]
