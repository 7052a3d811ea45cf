"""Near dedup of the pipeline: 5-word shingles, Jaccard similarity of 0.8 or more."""

import random

import corpus_pipeline
from gridproof.llm.jaccard import _Words, band_keys, shingles, sketches

SIZE = 5


def sets(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + SIZE]) for i in range(max(1, len(words) - SIZE + 1))}


def likeness(a, b):
    return len(sets(a) & sets(b)) / len(sets(a) | sets(b))


def replaced(words, n, rng):
    out = list(words)
    for at in rng.sample(range(len(words) // 10), n):
        out[at * 10 + 5] = f"new{rng.random()}"
    return " ".join(out)


def test_planted_pairs_about_the_limit(spark):
    rng, rows, over, under = random.Random(7), [], set(), set()
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        # a replaced word takes 5 of 396 shingles: 8 leave 356 of 436 (0.817), 9 leave 351 of 441 (0.796)
        rows += [(4 * k, " ".join(words)), (4 * k + 1, replaced(words, 8, rng)), (4 * k + 2, " ".join(f"v{rng.randrange(5000)}" for _ in range(60)))]
        assert likeness(rows[-3][1], rows[-2][1]) >= 0.8
        over.add(4 * k + 1)
        other = [f"u{rng.randrange(5000)}" for _ in range(400)]
        rows += [(1000 + 2 * k, " ".join(other)), (1001 + 2 * k, replaced(other, 9, rng))]
        assert 0.78 < likeness(rows[-2][1], rows[-1][1]) < 0.8
        under |= {1000 + 2 * k, 1001 + 2 * k}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert not kept & over and under <= kept and kept == {i for i, _ in rows} - over


def test_groups_with_outliers_and_texts_without_words(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join(words)]
    for step in range(4):  # each is like the one before, the ends are not alike
        chain.append(replaced(chain[-1].split(), 4, rng))
    copies = [replaced([f"c{i}" for i in range(400)], 2, rng) for _ in range(80)]
    rows = list(enumerate([*chain, *copies, "", "  ", None, "one two", "One  TWO", "one two three"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    n = len(chain) + len(copies)
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows:
        for j, b in rows[:i]:
            if likeness(a or "", b or "") >= 0.8:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert kept == {i for i, _ in rows if root(i) == i} and {n, n + 3, n + 5} <= kept and n + 4 not in kept


def test_bands_meet_at_the_limit():
    rng, memo, met = random.Random(1), _Words(), 0
    for _ in range(300):
        words = [f"w{rng.randrange(9999)}" for _ in range(400)]
        a, b = band_keys(sketches([shingles(t, memo) for t in (" ".join(words), replaced(words, 8, rng))]))
        met += bool((a == b).any())
    assert met == 300
