"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import new_path, table
from .fill_in_middle import fill_in_middle, restored
from .fingerprints import fingerprint_edits
from .html_text import extract_main_text
from .jaccard import similar_groups
from .language_id import predict, train
from .mixing import mix
from .packing import pack_documents
from .quality import quality
from .simhash import near_duplicates
from .suffix_dedup import repeated_spans
from .token_counts import token_counts
from .token_output import write_tokens
from .whitening import whiten


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = write_tokens(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return store.read(store.lookup(store.locations)).drop("copy")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("sx_bytes").alias("n_bytes"), F.col("sx_removed").alias("n_removed"), F.col("sx_spans").alias("n_spans"), F.sha2("sx_kept", 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = similar_groups(table(spark, sf_dir, "documents"), size=4, link_empty=False)
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}).drop("output")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_token_output, op2_suffix_dedup, op3_simhash, op4_fingerprints, op5_packing, op6_language_id, op7_mixing, op8_quality, op9_token_counts, op10_html_text, op11_minhash, op12_fill_in_middle, op13_whitening)}

ORACLE_SQL = {
    "op7_mixing": """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.7) AS w FROM documents GROUP BY source),
rates AS (SELECT source, w * ((SELECT sum(n) FROM sizes)::DOUBLE / (SELECT sum(w) FROM sizes)) / n AS rate FROM sizes),
cdf AS (
  SELECT source, rate, 0 AS k, -rate AS log_p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate / (k + 1)), c + exp(log_p + ln(rate / (k + 1))) FROM cdf WHERE k < rate + 12 * sqrt(rate) + 30
),
drawn AS (SELECT row_number() OVER () AS row, *, ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '-')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents),
counts AS (SELECT d.row, count(*) AS n FROM drawn d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND d.u >= cdf.c GROUP BY d.row),
copies AS (SELECT row, unnest(range(0, n)) AS copy FROM counts)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, md5('mix|' || coalesce(doc_id::VARCHAR, '-') || '|' || copy) AS mix_key FROM copies JOIN drawn USING (row)
""",
    "op12_fill_in_middle": """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
drawn AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM hashed
),
cut AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
parts AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
""",
}
