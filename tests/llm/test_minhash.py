"""Fast similarity sketches, banding and exact verification (op11), against brute force."""

import random

import numpy as np
import pytest

from gridproof.llm import buckets, jaccard
from gridproof.llm.jaccard import _Words, band_keys, exact_links, shingles, similar_groups, sketches
from gridproof.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def grams(text, size=4):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(rows, size=4, link_empty=False):
    """(id, n_shingles, component_id) of rows (id, text)."""
    sets = [grams(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            alike = 100 * len(a & b) >= 80 * len(a | b) if a and b else link_empty and a == b
            if alike or (rows[i][0] is not None and rows[i][0] == rows[j][0] and (link_empty or (a and b))):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, len(s), k if not s and not link_empty else least.get(root(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=repr)


def replaced(words, n, rng):
    out = list(words)
    for at in rng.sample(range(len(words) // 10), n):
        out[at * 10 + 5] = f"new{rng.random()}"
    return " ".join(out)


def corpus():
    rng, texts = random.Random(7), []
    for _ in range(8):
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        texts += [" ".join(words), *[replaced(words, n, rng) for n in range(1, 9)], " ".join(words[:170]), " ".join(words + words[:40])]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{rng.randrange(9999)}" for _ in range(rng.randrange(8, 60))) for _ in range(60)]
    texts += ["", None, " \n", "one", "One", "one two", "one two three four", "One Two  three FOUR", "one two three four five", "é Ü é Ü", "É ü é ü", "x " * 5000, "x " * 6000]
    rows = [(3 * i % 211, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_every_place_is_filled_and_places_agree_as_the_similarity():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (1, 2, 3, 10, 100, 5000)]
    assert (sketches(sets) != jaccard._NONE).all() and (sketches([np.empty(0, np.uint64)]) == jaccard._NONE).all() and len(sketches([])) == 0
    assert all((sketches([s])[0] == row).all() for s, row in zip(sets, sketches(sets)))  # whatever it is sketched with
    off = []
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 450, np.uint64)
        a, b = sketches([x[:400], x[50:]])  # 350 of 450
        off.append((a == b).mean() - 350 / 450)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 1.15 * (350 / 450 * 100 / 450 / jaccard.COORDINATES) ** 0.5


def test_rounds_are_those_of_the_definition():
    x = np.unique(np.random.default_rng(5).integers(0, 1 << 63, 30, np.uint64))
    t = jaccard.COORDINATES
    want = [None] * t
    for i in range(2 * t):
        for h in jaccard._mixed(x ^ jaccard._SEEDS[i]).tolist():
            b, v = ((h >> 32) * t >> 32 if i < t else i - t), i << 32 | h & 0xFFFFFFFF
            want[b] = v if want[b] is None else min(want[b], v)
        if None not in want:
            break
    assert sketches([x])[0].tolist() == want


def test_pairs_at_the_limit_meet_and_pass_the_bits():
    rng, memo, met = random.Random(1), _Words(), 0
    for _ in range(300):
        words = [f"w{rng.randrange(9999)}" for _ in range(400)]
        two = sketches([shingles(t, memo, 4) for t in (" ".join(words), replaced(words, 11, rng))])  # 44 of 397 each: 353 of 441
        bits = jaccard.sketch_bits(two).view(np.uint64)
        met += bool((band_keys(two)[0] == band_keys(two)[1]).any() and np.bitwise_count(bits[0] ^ bits[1]).sum() <= jaccard.FAR)
    assert met == 300


@pytest.mark.parametrize("inner", [True, False])
def test_exact_links_connect_what_brute_force_connects(inner):
    rng = np.random.default_rng(11)
    for _ in range(30):
        base = [rng.integers(0, 1 << 40, 40, np.uint64) for _ in range(3)]
        sets = [np.unique(np.concatenate([b[rng.random(40) < 0.95], rng.integers(0, 1 << 40, rng.integers(0, 6), np.uint64)])) for b in (base[k] for k in rng.integers(0, 3, 14))]
        label = rng.permutation(len(sets)) // 2
        first = rng.random(len(sets)) < 0.5

        def groups(links):
            at = label.copy()
            for i, j in links:
                at[at == at[i]] = at[j]
            return {frozenset(np.flatnonzero(at == x).tolist()) for x in at}

        allowed = lambda i, j: (first[i] or first[j]) if inner else first[i] != first[j]  # noqa: B023, E731
        alike = lambda a, b: 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
        want = [(i, j) for i in range(len(sets)) for j in range(i) if allowed(i, j) and alike(sets[i], sets[j])]
        found = exact_links(sets, label.copy(), first, inner)
        assert groups(found) == groups(want) and all(alike(sets[i], sets[j]) for i, j in found)


@pytest.mark.parametrize("small", [False, True])
def test_groups_against_brute_force(spark, monkeypatch, small):
    rows = corpus()
    if small:  # buckets and groups in blocks
        for name, value in (("BUCKET", 7), ("GROUP", 1200), ("BATCH", 3000)):
            monkeypatch.setattr(jaccard, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS node", "3 AS n", "4 AS component_id", "5 AS label")
    for size, link_empty in ((4, False),) if small else ((4, False), (5, True)):
        assert got(similar_groups(docs, size=size, link_empty=link_empty, prints=link_empty)) == brute(rows, size, link_empty)


def test_null_and_repeated_ids_and_empty_tables(spark):
    a, b, c = ("a b c d e f g h", "i j k l m n o p", "q r s t u v w x")
    rows = [(7, a), (7, b), (3, b), (9, c), (9, c), (None, c), (None, a), (None, "only without an id"), (5, None), (None, None)]
    for link_empty in (False, True):
        assert got(similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, link_empty=link_empty)) == brute(rows, 4, link_empty)
    assert similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts_that_share_a_passage_are_not_paired(spark):
    """A thousand texts with one passage meet in bands; what is moved stays in proportion to them."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(100))
    texts = [passage + " " + " ".join(f"q{rng.randrange(99999)}" for _ in range(45)) for _ in range(1000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = jaccard.sketched(docs, 4, False, "doc_id", "text").withColumn("node", jaccard.F.col("id"))
    assert jaccard.band_links(nodes, 1000).count() < 33_000
    assert {r.component_id for r in similar_groups(docs, 4).collect()} == set(range(1000))


def test_hot_keys_are_dealt_to_blocks(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("if(id < 2000, 1L, id) AS key", "id % 4 > 0 OR id > 1999 AS owner", "id AS member")
    met = buckets.dealt(rows, "member", 3000, 300).persist()
    sizes = met.groupBy("key", "x", "y").count().agg({"count": "max"}).first()[0]
    assert sizes < 800
    pairs = met.alias("a").join(met.alias("b"), ["key", "x", "y"]).filter("key = 1 AND a.owner AND a.member <> b.member").selectExpr("a.member AS p", "b.member AS q").distinct().count()
    assert pairs == 1500 * 1999  # each owner with every other member
    none = spark.range(2000).selectExpr("1L AS key", "false AS owner", "id AS member")
    assert buckets.dealt(none, "member", 2000, 300).count() == 0  # probes of a value that nobody has
    side = spark.createDataFrame([(1, "x", 2000), (2500, "y", 1)], "key long, name string, docs long")
    assert buckets.join_counted(rows, side, ["key"], "docs", 3000, 500).count() == 2001


def test_op11(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    rows = QUERIES["op11_minhash"](spark, DATA).collect()
    assert got(spark.createDataFrame([tuple(r) for r in rows], "doc_id long, n_shingles long, component_id long, kept boolean")) == brute([(r.doc_id, r.text) for r in table])
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
