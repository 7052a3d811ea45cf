"""Stages and queries of the training-data part."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from gridproof.llm import queries
from gridproof.llm._shared import written

DATA = "/root/testdata/sf0.001"


def five_words(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(spark.createDataFrame([(9001, None, None, "src0", None), (9002, "12 34 !", None, "src1", None)], "doc_id long, text string, lang string, source string, n_chars long"))
    names, kept = [n for n, _ in corpus_pipeline.STAGES], {}
    assert names == ["language_id", "simhash_dedup", "suffix_dedup", "mixing", "packing"]
    last = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in last.collect()}
        n_before = last.count()
        last = written(stage(spark, last, DATA), name)
        rows = last.collect()
        if name != "packing":
            assert last.columns == docs.columns
        after = {r.doc_id: r for r in rows}
        if name == "language_id":
            assert set(before) - set(after) == {9001, 9002}
        if name == "simhash_dedup":  # one document of each group of 5-word shingle sets with a Jaccard similarity of 0.8 or more
            sets = {k: five_words(r.text) for k, r in before.items()}
            group = {k: k for k in before}

            def root(x, group=group):
                while group[x] != x:
                    x = group[x]
                return x

            for a in sorted(before):
                for b in before:
                    if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root(a) != root(b):
                        group[max(root(a), root(b))] = min(root(a), root(b))
            assert set(after) == {k for k in before if root(k) == k} and len(rows) == len(after) and set(before) - set(after)
        if name == "suffix_dedup":
            assert set(after) == set(before) and sum(len(r.text) for r in after.values()) <= sum(len(r.text) for r in before.values())
            seen = {}
            for k in sorted(before):
                data = before[k].text.encode()
                keep = np.ones(len(data), bool)
                for i in range(len(data) - 49):
                    if seen.setdefault(data[i : i + 50], k) < k:
                        keep[i : i + 50] = False
                assert after[k].text == bytes(c for c, x in zip(data, keep) if x).decode("utf-8", "ignore") and after[k].n_chars == len(after[k].text)
        if name == "mixing":
            assert set(after) <= set(before) and 0.6 * n_before < len(rows) < 1.4 * n_before
        if name == "packing":
            enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            whole = {k: np.array(enc.encode(r.text, add_special_tokens=False).ids + [2], "<u4") for k, r in before.items()}
            assert all(r.ids_crc32 == zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows)
            assert sum(r.length for r in rows) == sum(len(whole[r.doc_id]) for r in kept["mixing"])
        kept[name] = rows


def test_run_and_queries(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 100 and corpus_pipeline.ORACLE_SQL is None
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, DATA)
        found = con.execute(sql)
        names = [x[0] for x in found.description]
        assert sorted(df.columns) == sorted(names)
        assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall())
    assert len(queries.QUERIES) == 13


def test_near_dedup_without_ids(spark):
    rows = [(None, "one text of its own"), (None, "one text of its own"), (None, "quite another matter here"), (3, "third thing said by nobody"), (3, "third thing said by nobody")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, DATA).collect()), key=repr)
    assert got == sorted({*rows}, key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0
