"""Each registered opN_ query, as the driver calls it, against brute force over the whole table."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_operators import brute_kept, brute_repeats
from tokenizers import Tokenizer

import __spark_entry__

DATA = "/root/testdata/sf0.001"
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def table(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def run(spark, start):
    found = {n: q for n, q in __spark_entry__.queries().items() if re.fullmatch(rf"{start}_.*", n) and n[2].isdigit()}
    assert len(found) == 1
    return next(iter(found.values()))(spark, DATA)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_op1(spark, table):
    library, at = Tokenizer.from_file(BYTE_BPE), 0
    got = {r.doc_id: r for r in run(spark, "op1").collect()}
    assert set(got) == set(table)
    for i in sorted(table):
        want = np.array([*ids(library, table[i].text), 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)


def test_op2(spark, table):
    want = brute_repeats({k: r.text or "" for k, r in table.items()})
    got = run(spark, "op2").collect()
    assert len(got) == len(table)
    for r in got:
        kept, removed, spans = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len((table[r.doc_id].text or "").encode()), removed, spans, hashlib.sha256(kept).hexdigest())


def test_op3(spark, table):
    got = {r.doc_id: r for r in run(spark, "op3").collect()}
    prints = {k: int(r.fingerprint, 16) for k, r in got.items()}
    group = {k: k for k in table}
    for _ in range(4):
        for a in sorted(table):
            group[a] = min([group[a], *[group[b] for b in table if (prints[a] ^ prints[b]).bit_count() <= 3]])
    assert {k: r.component_id for k, r in got.items()} == group


def test_op4(spark, table):
    got = {r.doc_id: r for r in run(spark, "op4").collect()}
    order = sorted(table, reverse=True)
    for a, b in zip(order, [*order[1:], order[0]]):
        t, n = table[a].text or "", len(table[a].text or "") // 3
        edited = t[: len(t) - n] + (table[b].text or "")[:n]
        assert (got[a].n_chars, got[a].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[a].near_edited <= 1 and (got[a].near_next == 1) == (got[a].fingerprint == got[b].fingerprint)


def test_op5(spark, table):
    library, seqs, pieces = Tokenizer.from_file(BYTE_BPE), {}, {}
    for r in run(spark, "op5").collect():
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(table)
    for i, rows in pieces.items():
        want, at = np.array([*ids(library, table[i].text), 2], "<u4"), 0
        for k, r in enumerate(sorted(rows, key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(want[at : at + r.length].tobytes())) and (k == 0 or r.length == 1024)
            at += r.length
        assert at == len(want)
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 1024


def test_op6(spark, table):
    got = run(spark, "op6").collect()
    assert len(got) == len(table) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and table[r.doc_id].lang and any(map(str.isalpha, table[r.doc_id].text or ""))]
    assert sum(r.lang_pred == table[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_op8(spark, table):
    got = run(spark, "op8").collect()
    want = brute_kept([(r.doc_id, r.text, r.source) for r in table.values()])
    assert sorted(((r.doc_id, r.n_removed_words, r.kept) for r in got), key=repr) == want
    for r in got:
        t = table[r.doc_id].text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))


def test_op9(spark, table):
    library = Tokenizer.from_file(WORD_BPE)
    got = run(spark, "op9").collect()
    assert len(got) == len(table)
    for r in got:
        t = table[r.doc_id].text or ""
        n = len(ids(library, t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 2048)


def test_op10(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = run(spark, "op10").collect()
    assert {r.page_id for r in got} == set(pages) and all(r.url == pages[r.page_id].url and r.n_chars == len(r.text) and r.text for r in got)
