"""Each training-data operator against brute force on small fixtures, with the hard cases of each."""

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridproof.llm import _tokens, suffix_dedup, suffix_sort, token_output
from gridproof.llm.components import connected_components
from gridproof.llm.fingerprints import HASHES, LANES, UNIT, alike, deleted, fingerprint, fingerprint_edits, inserted
from gridproof.llm.html_text import extract, extract_main_text
from gridproof.llm.language_id import fit, has_letter, predict, presence, sample, train
from gridproof.llm.mixing import cumulative, mix
from gridproof.llm.packing import PIECES, _across, bands, pack, pack_documents
from gridproof.llm.quality import quality
from gridproof.llm.simhash import near_duplicates, near_edges, simhash
from gridproof.llm.suffix_dedup import remove_repeats, repeated_spans
from gridproof.llm.token_counts import parts, token_counts
from gridproof.llm.token_output import build_mph, mph_slots, write_tokens

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "Here is one long passage that stands in several documents, word for word, with ünïcode. "
HARD = [
    "", None, " ", "a", "  two  spaces \n\n and\ttabs \r\n x", "it's they'll <|endoftext|> x<|endoftext|>", "1234 ² ½ 中文 字", "a\n\tb\n\t\tc", PASSAGE * 3, PASSAGE * 3, "x" * 3000,
    "To to to to to to to to to to to to to to to to to to to to", "é" * 120, "trailing ", "\n", "one\ntwo\none\nthree four\n \n", "!!! ??? ***",
]


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdeimnorstu"), rng.integers(2, 9))) + (".\n" if rng.random() < 0.1 else "") for _ in range(n)).replace("\n ", "\n")


def rows():
    texts = [*HARD, *[words(int(n), i) for i, n in enumerate(np.random.default_rng(1).integers(5, 900, 40))]]
    texts += [PASSAGE + words(60, 99) + PASSAGE, words(60, 98) + PASSAGE, texts[-1], texts[-2] + " end", texts[-3].replace("a", "e", 2)]
    docs = [(i * 3 % 1009, t, "en" if i % 2 else "fr", f"src{i % 4}" if i % 7 else None, None) for i, t in enumerate(texts)]
    return [*docs, (5000, texts[20], None, "src0", 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] or "" for r in rows()}


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, extra columns with clashing names."""
    data = [(None, "no id " * 30, 1), (None, None, 2), (7, "seven " * 40, 3), (7, "seven " * 40, 4), (7, "other text " * 30, 5), (9, None, 6)]
    return spark.createDataFrame(data, "doc_id long, text string, k long").selectExpr(
        "doc_id", "text", "'en' AS lang", "'s' AS source", "k", "k AS id", "k AS key", "k AS piece", "k AS part", "k AS fp", "k AS host", "k AS copy", "k AS n_words", "k AS sx_block", "k AS score", "k AS label", "k AS next"
    )


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pieces_encode_as_the_whole():
    for path in (BYTE_BPE, WORD_BPE):
        library, enc, count = Tokenizer.from_file(path), _tokens.Encoder(path), _tokens.Encoder(path, True)
        for t in [x for x in HARD if x] + [words(300, 5), "ªµº ﬁ ẛ̣ Σ ΑΣ", "\x00 a\x00", "x\n's y\n12", " lead", "a .b"]:
            want = library.encode(t, add_special_tokens=False).ids
            assert enc.ids(t).tolist() == want and count.counts([t, "a", t]) == [len(want), count.counts(["a"])[0], len(want)]
        assert enc.cuts and count.cuts


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(_tokens, "MEMO_LIMIT", 20)
    library, enc = Tokenizer.from_file(BYTE_BPE), _tokens.Encoder(BYTE_BPE)
    t = words(500, 3)
    assert enc.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids and len(enc.spaced) <= 20 and len(enc.spaced.older) <= 20


# 1
def test_token_store(spark, docs, texts, tmp_path):
    store = write_tokens(docs, f"file://{tmp_path}/t", BYTE_BPE, end_id=0)
    got = {r.doc_id: r for r in store.read(store.lookup(store.locations)).collect()}
    library, at = Tokenizer.from_file(BYTE_BPE), 0
    for i in sorted(texts):
        ids = np.array(library.encode(texts[i], add_special_tokens=False).ids + [0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    i = sorted(texts)[11]
    assert store.get(i).tolist() == [*library.encode(texts[i], add_special_tokens=False).ids, 0]
    assert store.get(123456789) is None


def test_point_lookup_reads_one_index_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("gridproof.llm.token_output.BUCKET_KEYS", 20)
    monkeypatch.setattr("gridproof.llm.token_output.BUCKETS_A_PART", 4)
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    store = write_tokens(docs, f"file://{tmp_path}/p", BYTE_BPE)
    assert store.buckets == 100 and store.index.count() == 100
    row = store.bucket_row(37)
    assert [r.bucket for r in row.collect()] == [37]
    plan = row._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    assert leaves.size() == 1 and leaves.apply(0).metrics().apply("numFiles").value() == 1 and leaves.apply(0).metrics().apply("numOutputRows").value() <= 256
    assert "PartitionFilters: [isnotnull(part" in plan.toString()
    library = Tokenizer.from_file(BYTE_BPE)
    for i in (0, 1, 777, 1999):
        assert store.get(i).tolist() == [*library.encode(f"text {i}", add_special_tokens=False).ids, 0]
    assert store.get(2000) is None and store.get(5, 1) is None and store.get(None) is None


def test_one_id_over_several_shards(spark, tmp_path):
    docs = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN 77 WHEN id % 3 = 1 THEN null ELSE id END AS doc_id", "concat('text ', id) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = write_tokens(docs, f"file://{tmp_path}/h", BYTE_BPE)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_id = store.locations.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("copies"), F.max("copy").alias("top"), F.count_distinct("shard").alias("shards"))
    got = {r.doc_id: r for r in by_id.filter("n > 1").collect()}
    assert set(got) == {77, None} and all(r.n == r.copies == r.top + 1 and r.shards > 1 for r in got.values())
    assert store.read(store.lookup(store.locations)).count() == 4000 and store.get(77, 1200) is not None and store.get(None, 900) is not None


def test_keys_with_one_hash_are_kept(spark, tmp_path, monkeypatch):
    place = pd.DataFrame({"doc_id": pd.Series([5, None, 6], dtype="Int64"), "copy": [0, 0, 1]})
    twins = np.array([[0, 5, 0, 1, 2, 3], [1, 0, 0, 4, 5, 6]], "<i8").tobytes()
    row = {"sizes": b"", "bits": b"", "rest": b"", "prints": b"", "shard": b"", "offset": b"", "n_ids": b"", "twins": twins}
    found = token_output._find(place, row)
    assert found[["shard", "offset", "n_ids"]].values.tolist() == [[1, 2, 3], [4, 5, 6]]


def test_token_store_odd_and_empty(spark, odd, empty, tmp_path):
    store = write_tokens(odd, f"file://{tmp_path}/o", BYTE_BPE)
    got = store.read(store.lookup(store.locations)).collect()
    assert Counter(r.doc_id for r in got) == {None: 2, 7: 3, 9: 1} and sorted(r.start for r in got)[0] == 0
    store = write_tokens(empty, f"file://{tmp_path}/e", BYTE_BPE)
    assert store.read(store.lookup(store.locations)).count() == 0 and store.get(1) is None


def test_minimal_perfect_hash():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    keys = np.unique(keys)
    slots = mph_slots(keys, *build_mph(keys))
    assert sorted(slots.tolist()) == list(range(len(keys)))


# 2
def brute_repeats(texts, n=50):
    first = {}
    data = {k: t.encode() for k, t in texts.items()}
    for k in sorted(data):
        for i in range(len(data[k]) - n + 1):
            first.setdefault(data[k][i : i + n], k)
    out = {}
    for k, t in data.items():
        mark = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if first[t[i : i + n]] < k:
                mark[i : i + n] = b"\1" * n
        out[k] = (bytes(c for c, m in zip(t, mark) if not m), sum(mark), len(re.findall(b"\1+", mark)))
    return out


def split_finely(monkeypatch, block=4 << 20, fan=4096, hot=8192, piece=1 << 18):
    for name, value in (("BLOCK_BYTES", block), ("PART_BYTES", block), ("FAN", fan), ("HOT", hot), ("PIECE", piece)):
        monkeypatch.setattr(f"gridproof.llm.suffix_dedup.{name}", value)


@pytest.mark.parametrize("sizes", [(4 << 20,), (20_000,), (20_000, 2), (40_000, 4096, 2), (20_000, 3, 3, 700)], ids=["one block", "blocks", "two levels", "hot keys", "all"])
def test_repeats(spark, docs, texts, monkeypatch, sizes):
    split_finely(monkeypatch, *sizes)
    want = brute_repeats(texts)
    for r in repeated_spans(docs).collect():
        assert (bytes(r.sx_kept), r.sx_removed, r.sx_spans) == want[r.doc_id]


def test_a_frequent_phrase_in_varied_context(spark, monkeypatch):
    split_finely(monkeypatch, 4000, 4096, 20)
    phrase = "this very phrase stands everywhere"  # under 50 bytes: nothing that goes
    data = {i: " ".join([words(12, i), phrase, words(12, 1000 + i)]) for i in range(120)}
    data |= {200 + i: " ".join([words(5, 500 + i), data[i][40:140], words(5, 700 + i)]) for i in range(0, 120, 7)}
    want = brute_repeats(data)
    got = repeated_spans(spark.createDataFrame(sorted(data.items()), "doc_id long, text string")).collect()
    assert len(got) == len(data) and sum(r.sx_removed for r in got) > 0
    for r in got:
        assert (bytes(r.sx_kept), r.sx_removed, r.sx_spans) == want[r.doc_id]


def test_messages_grow_with_the_input_not_with_the_parts():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 60_000).astype(np.uint64) << np.uint64(1))
    rows = {}
    for parts in (100, 1000, 10_000, 1_000_000):
        plan = suffix_dedup._Plan(parts * suffix_dedup.PART_BYTES)
        rows[parts] = sum(1 for _ in suffix_dedup._dealt(plan.bucket(keys), [keys]))
        assert plan.buckets * plan.deep >= parts and len(list(suffix_dedup._dealt(plan.parts(keys & np.uint64(0xFFFFFFFF)), [keys]))) <= suffix_dedup.FAN
    assert rows == {100: 100, 1000: 1000, 10_000: 4096, 1_000_000: 4096}


def test_repeats_odd_and_empty(spark, odd, empty):
    got = [(r.doc_id, r.sx_removed, r.k) for r in repeated_spans(odd).collect()]
    assert len(got) == 6 and all(n == 0 for _, n, _ in got)  # rows of one id never cut each other
    same = spark.createDataFrame([(None, "q " * 60, 1), (3, "q " * 60, 2)], "doc_id long, text string, k long")
    assert {r.k: r.sx_removed for r in repeated_spans(same).collect()} == {1: 120, 2: 0}  # null ids come last
    assert repeated_spans(empty).count() == 0
    assert remove_repeats(spark.createDataFrame([(1, "ü" * 40, 9), (2, "x" + "ü" * 40, 9)], "doc_id long, text string, n_chars int")).orderBy("doc_id").collect()[1].text == "x"


def test_deep_shallow_order(monkeypatch):
    monkeypatch.setattr(suffix_sort, "SMALL", 20)  # so that groups are split by pivots
    rng = np.random.default_rng(2)
    rows = np.repeat(rng.integers(97, 99, (40, 50)).astype(np.uint8), 6, 0)
    rows[::6, 45:] = 1
    rows[1::6, 30] = 2
    order, equal = suffix_sort.deep_shallow_sort(rows)
    data = [rows[i].tobytes() for i in order]
    assert data == sorted(r.tobytes() for r in rows)
    assert [b - a for a, b in zip(equal, equal[1:])] == [int(x != y) for x, y in zip(data, data[1:])]


# 3
def test_simhash_components(spark, docs, texts):
    def brute(t):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        counts = [sum(xxhash.xxh64_intdigest(x.encode(), 42) >> b & 1 for x in s) for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * counts[b] > len(s))

    want = {k: brute(t) for k, t in texts.items()}
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == want
    group = {k: k for k in texts}
    for _ in texts:
        for a in texts:
            group[a] = min([group[a], *[group[b] for b in texts if (want[a] ^ want[b]).bit_count() <= 3]])
    assert {k: r.component_id for k, r in got.items()} == group


@pytest.mark.parametrize("block", [8192, 50])
def test_planted_distances_all_link(spark, monkeypatch, block):
    """Every pair within 3 bits is connected and no link is longer, in random values, a ball, and a bucket of over TILE members."""
    monkeypatch.setattr("gridproof.llm.simhash.BLOCK", block)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 300, np.uint64)
    values = {int(x) for x in base}
    for x in base.tolist():
        for d in (1, 2, 3, 4, 5):
            values.add(x ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    centre = int(base[0])
    values |= {centre ^ 1 << i ^ 1 << j for i in range(32) for j in range(i)}  # 496 within 4 bits of each other
    values |= {(centre & ~0xFFFFFFFF) ^ 1 << 40 | int(x) for x in rng.integers(0, 1 << 32, 1500)}  # one segment in common
    fps = np.array(sorted(values), np.uint64)
    edges = near_edges(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    number = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for r in edges:
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3
        parent[root(number[r.a])] = root(number[r.b])
    near = 0
    for i in range(len(fps)):
        at = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3)
        near += len(at) - 1
        assert len({root(int(k)) for k in at}) == 1
    assert near > 3000


def test_simhash_chains_odd_and_empty(spark, odd, empty):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (0, 40)], "a long, b long")
    assert {r.id: r.component for r in connected_components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    got = near_duplicates(odd).collect()
    assert len(got) == 6 and {r.component_id for r in got if r.doc_id == 7} == {7} and {r.component_id for r in got if r.doc_id == 9} == {9}
    assert near_duplicates(empty).count() == 0
    assert simhash("A b") == xxhash.xxh64_intdigest(b"a b", 42)


# 4
def test_fingerprints(spark, docs, texts):
    got = {r.doc_id: r for r in fingerprint_edits(docs).collect()}
    ids = sorted(texts, reverse=True)
    for a, b in zip(ids, [*ids[1:], ids[0]]):
        t, n = texts[a], len(texts[a]) // 3
        edited = t[: len(t) - n] + texts[b][:n]
        assert (got[a].n_chars, got[a].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[a].near_next == 1.0) == (got[a].fingerprint == got[b].fingerprint) and 0 <= got[a].near_edited <= 1
    by_print = {}
    for k, r in got.items():
        by_print.setdefault(r.fingerprint, set()).add(texts[k])
    assert all(len(v) == 1 for v in by_print.values()) and len(by_print) == len(set(texts.values()))
    longer = [r for k, r in got.items() if len(texts[k].split()) > 200]
    assert np.median([r.near_edited for r in longer]) > 0.5 > np.median([r.near_next for r in longer])


def test_fingerprint_is_a_multiset_hash(spark):
    a, b = "first line of words here\n", "second line of words there\n"
    df = spark.createDataFrame([(1, a + b), (2, b + a), (3, a + a + b)], "doc_id long, text string")
    p = {r.doc_id: r.fingerprint for r in fingerprint_edits(df).collect()}
    assert p[1] == p[2] != p[3]
    lanes = lambda x: [int(x[i : i + 4], 16) for i in range(0, len(x), 4)]
    alone = {r.doc_id: r.fingerprint for r in fingerprint_edits(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()}
    assert lanes(p[1]) == [(x + y) % 65536 for x, y in zip(lanes(alone[1]), lanes(alone[2]))]  # insertion is a sum


def test_likeness_is_that_of_the_fingerprints(spark):
    """near_* from the hex digits alone, against sums of hashed units; insertion and deletion of paragraphs."""
    a, b = words(300, 31), words(260, 32)
    wide = "x. " * 70_000  # a lane's sum leaves 16 bits
    df = spark.createDataFrame([(3, a), (2, b), (1, a[:900] + b), (0, wide)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint_edits(df).collect()}

    def vector(text):
        total = np.zeros(LANES, np.int64)
        for unit in re.finditer(UNIT, text):
            if unit[0]:
                h0 = xxhash.xxh64_intdigest(unit[0].encode(), 42)
                for k in range(HASHES):
                    h = xxhash.xxh64_intdigest(int(k).to_bytes(4, "little"), h0)
                    bits = np.array([h >> i & 1 for i in range(64)])
                    # as the fingerprint orders them: all low counters, then all high ones
                    total[32 * k : 32 * k + 32] += 2 * bits[:32] - 1
                    total[LANES // 2 + 32 * k : LANES // 2 + 32 * k + 32] += 2 * bits[32:] - 1
        return (total + 32768) % 65536 - 32768

    def cosine(x, y):
        x, y = x.astype(float), y.astype(float)
        return 1.0 if (x == y).all() else min(1.0, max(0.0, float(x @ y) / math.sqrt(float(x @ x) * float(y @ y))))

    for i, after in ((3, 2), (2, 1), (1, 0), (0, 3)):
        text = {3: a, 2: b, 1: a[:900] + b, 0: wide}
        n = len(text[i]) // 3
        assert got[i].fingerprint == "".join(f"{int(x) % 65536:04x}" for x in vector(text[i]))
        assert math.isclose(got[i].near_next, cosine(vector(text[i]), vector(text[after])), abs_tol=1e-9)
        assert math.isclose(got[i].near_edited, cosine(vector(text[i]), vector(text[i][: len(text[i]) - n] + text[after][:n])), abs_tol=1e-9)
    lines = ["first paragraph of its own\n", "a second one, here\n", "the third\n"]
    one = spark.createDataFrame([(0, "".join(lines)), (1, lines[0] + lines[2]), (2, lines[1]), (3, lines[2] + lines[1] + lines[0])], "doc_id long, text string")
    p = {r.doc_id: r.fingerprint for r in fingerprint(one).collect()}
    x = spark.createDataFrame([(p[0], p[1], p[2])], "all string, two string, one string")
    r = x.select(inserted(F.col("two"), F.col("one")).alias("i"), deleted(F.col("all"), F.col("one")).alias("d"), alike(F.col("all"), F.col("all")).alias("same")).first()
    assert r.i == p[0] == p[3] and r.d == p[1] and r.same == 1.0


def test_fingerprints_odd_and_empty(spark, odd, empty):
    got = fingerprint_edits(odd).collect()
    assert Counter(r.doc_id for r in got) == {None: 2, 7: 3, 9: 1} and fingerprint_edits(empty).count() == 0
    assert fingerprint_edits(spark.createDataFrame([(1, "only one")], "doc_id long, text string")).first().near_next == 1.0


# 5
def test_packing(spark, docs, texts):
    rows = pack_documents(docs, BYTE_BPE, capacity=64, end_id=2).collect()
    library, seqs = Tokenizer.from_file(BYTE_BPE), {}
    for k, t in texts.items():
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4")
        mine, at = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece), 0
        for i, r in enumerate(mine):
            assert (r.piece, r.start, r.ids_crc32) == (i, at, zlib.crc32(ids[at : at + r.length].tobytes())) and (i == 0 or r.length == 64)
            at += r.length
        assert at == len(ids)
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 64
    gaps = []  # best fit decreasing, one by one
    for n in sorted((r.length for r in rows), reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(64 - n)
    assert len(seqs) == len(gaps)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, n)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        bisect.insort(gaps, gap - n)
    return len(gaps)


@pytest.mark.parametrize("kind", ["even", "short", "hot", "halves"])
def test_packing_needs_no_more_than_best_fit(spark, monkeypatch, kind):
    monkeypatch.setattr("gridproof.llm.packing.ROWS_A_TASK", 500)  # several ranges, so that leftovers meet across them
    rng = np.random.default_rng(3)
    lengths = {"even": rng.integers(1, 1025, 4000), "short": rng.integers(1, 90, 4000), "hot": np.where(rng.random(4000) < 0.4, 300, rng.integers(1, 1025, 4000)), "halves": rng.integers(300, 513, 3000)}[kind]
    rows = [(i, 0, 0, int(n), 0, i) for i, n in enumerate(lengths)]
    got = pack(spark.createDataFrame(rows, PIECES).repartition(3)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(lengths)))
    seqs = {}
    for r in got:
        assert r.length == lengths[r.doc_id]
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 1024
    fewest = max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()))
    print(kind, len(seqs), best_fit_decreasing(lengths.tolist(), 1024), fewest)
    assert len(seqs) <= max(best_fit_decreasing(lengths.tolist(), 1024) * 1.001, fewest + 1)


def test_leftovers_of_ranges_meet_the_nearest():
    met, left = _across([(0, 1, 3), (1, 2, 1), (2, 4, 0)])
    assert left == [(0, 0, 0), (2, 2, 1)]
    assert met == [(1, 0, 2, 0, 2), (2, 0, 1, 1, 0), (2, 1, 2, 0, 1)]
    assert bands(1024)[:3] == [(512, 1024), (341, 512), (256, 341)] and bands(1024)[-1][0] == 0 and bands(1) == [(0, 1)]
    for c in (2, 64, 1000, 1024):
        assert all(b[0] == a[1] for a, b in zip(bands(c)[1:], bands(c)))


def test_packing_odd_and_empty(odd, empty):
    assert Counter(r.doc_id for r in pack_documents(odd, BYTE_BPE).collect()) == {None: 2, 7: 3, 9: 1}
    assert pack_documents(empty, BYTE_BPE).count() == 0


# 6
def test_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(d.filter(~out), per_language=60)
    got = predict(d.filter(out), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)
    hard = predict(spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "the")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in hard[:3]] == ["und"] * 3 and hard[3].lang_pred in model[0]
    assert not has_letter("½ 1 _") and has_letter("1é")


def test_kernel_ridge_against_brute_force():
    """With all rows as landmarks the map is exact, so the scores are those of kernel ridge regression in its dual form; chunks don't matter."""
    texts = [words(30, i) if i % 2 else " ".join(w[::-1] + "x" for w in words(30, i).split()) for i in range(24)]
    labels = ["a" if i % 2 else "b" for i in range(24)]
    bits = np.stack([presence(t) for t in texts])
    names, weights = fit(bits[:20], labels[:20], landmarks=20, ridge=1e-2)
    x = bits / np.sqrt(bits.sum(1, keepdims=True))
    kernel, y = x[:20] @ x[:20].T, np.where(np.array(labels[:20])[:, None] == np.array(names), 1.0, -1.0)
    want = x[20:] @ x[:20].T @ np.linalg.solve(kernel + 1e-2 * np.eye(20), y)
    got = bits[20:].astype(np.float32) @ weights / np.sqrt(bits[20:].sum(1, keepdims=True))
    assert names == ["a", "b"] and np.abs(got - want).max() < 1e-3
    text = words(400, 3) + "é€😀" * 20
    whole = presence(text)
    for size in (7, 64, 1001):
        assert (presence(text, size) == whole).all()


def test_sample_is_bounded_where_one_id_holds_most_rows(spark):
    rows = [(7, f"hot text {i % 3}", "en") for i in range(900)] + [(None, f"text number {i}", "fr") for i in range(300)]
    bits, labels = sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=40)
    assert Counter(labels) == {"en": 3, "fr": 40} and len(bits) == 43


def test_languages_odd_and_empty(odd, empty):
    model = train(odd)
    assert model[0] == ["en"] and predict(odd, model).count() == 6
    nothing = train(empty)
    assert nothing[0] == [] and {r.lang_pred for r in predict(odd, nothing).collect()} == {"und"}


# 7
def test_mixing(spark, odd, empty):
    d = spark.range(8000).selectExpr("id AS doc_id", "CASE WHEN id % 10 = 0 THEN 'small' WHEN id % 10 = 1 THEN null ELSE 'big' END AS source", "id AS copy")
    got = mix(d, {"small": 1.0, "big": 1.0, None: 0.0})
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert set(n) == {"small", "big"} and abs(n["small"] - 4000) < 260 and abs(n["big"] - 4000) < 260  # 4 deviations
    counts = got.filter("source = 'small'").groupBy("doc_id").count().selectExpr("avg(count * count) - avg(count) * avg(count)").first()[0]
    assert 3.5 < counts < 6.5  # Poisson: the variance is the mean, 5
    assert got.select("mix_key").distinct().count() == got.count()
    assert mix(empty).count() == 0 and set(mix(odd, total=20.0).select("doc_id").distinct().toPandas()["doc_id"].dropna()) <= {7, 9}


@pytest.mark.parametrize("rate", [0.0, 0.1, 5.0, 745.0, 800.0, 2000.0, 3e5])
def test_poisson_rates(rate):
    low, cdf = cumulative(rate)
    p = np.diff(cdf, prepend=0.0)
    k = low + np.arange(len(p))
    mean = (p * k).sum()
    assert abs(cdf[-1] - 1) < 1e-8 and abs(mean - rate) <= 1e-7 * max(1, rate) and abs((p * (k - mean) ** 2).sum() - rate) <= 1e-5 * max(1, rate)
    for x in (k[p.argmax()], max(0, int(rate) - 3)) if rate else ():
        assert math.isclose(p[x - low], math.exp(x * math.log(rate) - rate - math.lgamma(x + 1)), rel_tol=1e-6)


@pytest.mark.parametrize("rate", [0.1, 5.0, 800.0, 2000.0])
def test_copies_by_rate(spark, rate):
    n = 4000 if rate < 10 else 60
    docs = spark.range(n).selectExpr("id AS doc_id", "'s' AS source").unionByName(spark.range(5).selectExpr("-1 - id AS doc_id", "'none' AS source"))
    got = mix(docs, {"s": 1.0}, total=rate * n / (n + 5)).groupBy("doc_id").count().collect()
    counts = np.zeros(n)
    counts[[r.doc_id for r in got]] = [r["count"] for r in got]  # those of the other source would fail
    assert abs(counts.mean() - rate) < 5 * math.sqrt(rate / n) and (n < 100 or abs(counts.var() / rate - 1) < 0.3)


def test_mixing_is_in_the_order_of_its_key(spark):
    got = mix(spark.range(3000).selectExpr("id AS doc_id", "'s' AS source"), partitions=7).select(F.spark_partition_id().alias("p"), "mix_key").collect()
    assert [r.mix_key for r in got] == sorted(r.mix_key for r in got) and len({r.p for r in got}) == 7


# 8
def test_quality(spark, docs, texts):
    got = {r.doc_id: r for r in quality(docs).collect()}
    for k, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", t)
        win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and (r.kept or r.base_failed)


def test_boilerplate(spark, odd, empty):
    own = [(i, words(40, i) + "\nCLICK  here to read more of this kind today", "h") for i in range(30)]
    gone = [(100 + i, "Click here to read more of this kind today\n" * 1 + "click here to read more of this kind today\n" * 2, "h") for i in range(2)]
    other = [(200, "click here to read more of this kind today\n" + words(12, 7), "rare")]
    got = {r.doc_id: r for r in quality(spark.createDataFrame([*own, *gone, *other], "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept and got[i].n_removed_words == 9 for i in range(30))
    assert not got[100].kept and got[100].n_removed_words == 27 and got[200].kept and got[200].n_removed_words == 0
    assert quality(odd).count() == 6 and quality(empty).count() == 0


def brute_kept(rows):
    """kept by (doc_id, text) rows, one by one, with lists and dicts."""
    word = lambda t: re.findall("[^\x20\x09-\x0d]+", t or "")
    normal = lambda x: " ".join(word(x)).lower()
    hosts, seen = Counter(), Counter()
    for _, t, host in rows:
        hosts[host or ""] += 1
        for line in {normal(x) for x in (t or "").split("\n") if word(x)}:
            seen[host or "", line] += 1
    out = []
    for i, t, host in rows:
        w = word(t)
        win = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if win[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        gone = sum(len(word(x)) for x in (t or "").split("\n") if word(x) and seen[host or "", normal(x)] > max(20, 0.0005 * hosts[host or ""]))
        left = len(w) - gone
        out.append((i, gone, len(w) >= 20 and 100 * len(covered) <= 30 * len(w) and left >= 10 and left >= 0.3 * len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [200_000, 0])
def test_quality_verdicts(spark, monkeypatch, most):
    monkeypatch.setattr("gridproof.llm.quality.BROADCAST_LINES", most)  # 0: the salted join
    rng, rows = np.random.default_rng(5), []
    common = [f"Share this page with {w} friends of yours now" for w in ("all", "two", "no")]
    for i in range(400):
        lines = [words(int(rng.integers(3, 30)), 1000 + i)] + [c.upper() if rng.random() < 0.2 else c for c in common if rng.random() < 0.4]
        rows.append((i, "\n".join(rng.permutation(lines)), ["a", "b", None][i % 3] if i < 380 else "small"))
    rows += [(7, rows[7][1], "a"), (None, rows[8][1], "a"), (None, None, "a"), (5000, common[0] + "\n" + " ".join(common), "a")]
    got = quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(((r.doc_id, r.n_removed_words, r.kept) for r in got), key=repr) == brute_kept(rows)
    assert {r.kept for r in got} == {True, False}


# 9
@pytest.mark.parametrize("split", [1 << 20, 700, 40])
def test_token_counts(docs, texts, odd, empty, split):
    library = Tokenizer.from_file(WORD_BPE)
    for r in token_counts(docs, WORD_BPE, limit=100, split_chars=split, batch_bytes=3000).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 100)
    assert token_counts(odd, WORD_BPE).count() == 6 and token_counts(empty, WORD_BPE).count() == 0


def test_long_texts_are_cut():
    long = words(4000, 8) + "\u00a0 \u00a0 x  y\n z" + "q" * 900
    cut = list(parts(long, 500))
    assert len(cut) > 30 and "".join(cut) == long and all(len(p) < 2000 for p in cut)
    library, enc = Tokenizer.from_file(WORD_BPE), _tokens.Encoder(WORD_BPE, True)
    assert sum(enc.counts(cut)) == len(library.encode(long, add_special_tokens=False).ids)


def test_a_tokenizer_that_crosses_spaces_takes_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer as T, models

    vocab = {c: i for i, c in enumerate(" abxy.\n")} | {"a b": 90, "a ": 91}
    tokenizer = T(models.BPE(vocab=vocab, merges=[("a", " "), ("a ", "b")]))
    tokenizer.save(f"{tmp_path}/t.json")
    assert not _tokens.cuts_at_spaces(tokenizer)
    got = token_counts(spark.createDataFrame([(1, "a ba b"), (2, "x y")], "doc_id long, text string"), f"{tmp_path}/t.json").orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [2, 3]


def test_sentencepiece_models(spark, docs, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert all(r.n_tokens == len(model.encode(texts[r.doc_id])) for r in token_counts(docs, path).collect())


# 10
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><div class="cookie-notice">We use cookies</div>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy &amp; save</div><article><h1>Head  line</h1><p><b>First &lt;b&gt;<br><p>Second&nbsp;&#233; paragraph
with a break.</p><p>Short.</p></article><section id="comments"><p>I think this is a long reader comment about it.</p></section><form>Your mail <input></form><aside>Side</aside><footer>&copy; me</footer>"""


def test_html():
    assert extract(PAGE) == "Head line\n\nFirst <b>\n\nSecond é paragraph with a break.\n\nShort."
    body = "".join(f"<p>{words(40, i)}</p>" for i in range(5))
    plain = f"<html><body><div><a href=a>x</a><a href=b>y</a> <a href=c>z</a></div><div>{body}</div><div><a href=d>more</a></div></body></html>"
    assert extract(plain) == "\n\n".join(" ".join(words(40, i).split()) for i in range(5))
    assert extract(None) == extract("") == extract("<p></p>") == "" and extract("just text") == "just text"


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 1), (None, None, None, 2), (1, "u", PAGE, 3)], "page_id long, url string, html string, text long")
    got = extract_main_text(df).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got) and extract_main_text(df.limit(0)).count() == 0
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.join(extract_main_text(pages).select("page_id", "text"), "page_id").collect():
        inside = r.html[r.html.index("<article>") : r.html.index("</article>")]
        assert set(re.sub("<[^>]+>", " ", inside).split()) == set(r.text.split()) or "&" in inside
