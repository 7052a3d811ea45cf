"""Paragraph order, hot ids, clashing columns, and vocabularies with tokens over spaces."""

import random

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from gridproof.llm import _tokens, fingerprints, mixing, suffix_dedup
from gridproof.llm.fingerprints import deleted, fingerprint, fingerprint_edits, inserted
from gridproof.llm.mixing import mix
from gridproof.llm.suffix_dedup import repeated_spans


def prints(spark, texts):
    got = fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.fingerprint for r in sorted(got)]


def test_paragraphs_count_alike_wherever_they_stand(spark):
    a, b, c = "First paragraph, of some words. And more of them here.", "Second one.", "The third has three sentences. This is the second. And a last one!"
    texts = [f"{a}\n{b}", f"{b}\n{a}", a, b, f"{c}\n{a}\n{b}\n", f"{a}\n{b}\n{c}", f"{b}\n{c}\n{a}", c, f"{a}\n{b}\n{a}"]
    p = prints(spark, texts)
    assert p[0] == p[1] and p[4] == p[5] == p[6] and len({p[0], p[2], p[3], p[4], p[7], p[8]}) == 6
    row = spark.createDataFrame([tuple(p)], ", ".join(f"p{i} string" for i in range(len(p))))
    ab, left, twice = row.select(inserted(F.col("p2"), F.col("p3")), deleted(F.col("p4"), F.col("p7")), inserted(F.col("p0"), F.col("p2"))).first()
    assert ab == p[0] and left == p[0] and twice == p[8]


def test_units_are_the_text_without_line_ends(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word ", "x.", "! ", "\n", "  ", "\t", "é", "\r\n", "a.b.c "]) for _ in range(60)) for _ in range(40)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprints.units(F.col("t")).alias("u")).collect()
    assert all("".join(r.u) == r.t.replace("\n", "") for r in got)


def test_one_id_in_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "HOT_ROWS", 20)
    rows = [(7 if i % 3 else i, f"Text number {i % 11} of the table. " * 3) for i in range(300)] + [(None, "no id here. " * 4)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    many = sorted(map(tuple, fingerprint_edits(docs).collect()), key=repr)
    monkeypatch.setattr(fingerprints, "HOT_ROWS", 10_000)
    assert many == sorted(map(tuple, fingerprint_edits(docs).collect()), key=repr) and len(many) == 350
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)
    passage = "a passage of over fifty bytes, which stands in several of the documents, "
    texts = spark.createDataFrame([(7, f"{passage}{i}") for i in range(200)] + [(9, f"{passage}nine"), (3, "short")], "doc_id long, text string").repartition(4)
    got = repeated_spans(texts).collect()
    assert all((r.sx_removed > 0) == (r.doc_id == 9) for r in got) and len(got) == 202


def test_columns_of_any_name_come_back_from_mixing(spark, monkeypatch):
    names = ["mix_n", "mix_rate", "mix_low", "mix_cdf", "mix_source", "mix_rows", "mix_u", "mix_id", "mix_name", "mix_row"]
    docs = spark.range(500).selectExpr("id AS doc_id", "if(id % 5 = 0, null, concat('s', id % 3)) AS source", *[f"id * 10 + {i} AS {n}" for i, n in enumerate(names)])
    got = mix(docs, total=2.0).collect()
    assert len(got) > 600 and all(r[n] == r.doc_id * 10 + i for r in got for i, n in enumerate(names))
    monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", 1)
    assert sorted(map(tuple, mix(docs, total=2.0).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_tokens_over_a_space_stop_the_cuts(tmp_path):
    for middle, other in (("Ġ", "xĠ"), ("▁", "Âł")):
        letters = [*"ofthe", middle, "Â", "ł"]
        merges = [("o", "f"), ("t", "h"), ("th", "e"), ("of", middle), (f"of{middle}", "the")]
        vocab = {t: i for i, t in enumerate(dict.fromkeys([*letters, "of", "th", "the", f"of{middle}", f"of{middle}the"]))}
        t = Tokenizer(models.BPE(vocab, merges))
        t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        assert _tokens.crosses_spaces(t) and not _tokens.cuts_at_spaces(t)
        t.save(str(tmp_path / "t.json"))
        if middle == "Ġ":
            enc = _tokens.Encoder(str(tmp_path / "t.json"))
            assert enc.ids("of the of the").tolist() == t.encode("of the of the").ids and np.array_equal(enc.ids("of"), [vocab["of"]])
