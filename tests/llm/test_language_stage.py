"""The language stage of the pipeline keeps learned languages, short texts too, and drops all else."""

import random
import zlib

import corpus_pipeline

DATA = "/root/testdata/sf0.01"


def test_foreign_junk_and_code_go(spark):
    rng = random.Random(5)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    clean = [r for r in docs.filter("length(text) > 0").collect() if any(map(str.isalpha, r.text))]
    held = {r.doc_id for r in clean if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    letters = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    alien = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
        "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím.",
        letters("bcdfghjklmnpqrstvwxz", 800),
        " ".join(letters("abcdefghijklmnopqrstuvwxyz", rng.randint(2, 9)) for _ in range(200)),
        letters("0123456789abcdef", 800),
        "static int parse(struct buf *b, size_t n) { for (size_t i = 0; i < n; i++) { if (b->data[i] == '\\n') return -1; b->len++; } return memcmp(b->data, hdr, sizeof(*hdr)); }",
    ]
    # held out: without a label they are no examples, but must stay
    rows = [(r.doc_id, r.text, None if r.doc_id in held else r.lang, r.source, r.n_chars) for r in clean]
    rows += [(10**6 + i, t, None, "web", len(t)) for i, t in enumerate(alien)]
    short = [r.text[: r.text.index(" ", 20)] for r in clean if r.doc_id in held and " " in r.text[20:40]][:50]
    rows += [(2 * 10**6 + i, t, None, "web", len(t)) for i, t in enumerate(short)]
    kept = {r.doc_id for r in corpus_pipeline.languages(spark, spark.createDataFrame(rows, docs.schema), "").collect()}
    assert not kept & {10**6 + i for i in range(len(alien))}
    assert len(held - kept) <= len(held) // 100 and {r.doc_id for r in clean} - held <= kept
    assert len(short) > 30 and sum(2 * 10**6 + i in kept for i in range(len(short))) >= len(short) - 1
