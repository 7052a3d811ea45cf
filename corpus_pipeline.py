"""A corpus pipeline of five stages; each takes the documents its predecessor kept.

Language identification, near-dedup (SimHash of 5-word shingles with multi-index hashing first, bands of fast similarity sketches for what lies farther, and the
Jaccard similarity of whole shingle sets to decide), removal of repeated strings, mixing of sources, and packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridproof.llm._shared import table, written
from gridproof.llm.jaccard import similar_groups
from gridproof.llm.language_id import fit, limits, predict, sample
from gridproof.llm.mixing import mix
from gridproof.llm.packing import pack_documents
from gridproof.llm.suffix_dedup import remove_repeats


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents and drop what is in no language: no text, no letter, or too few n-grams that any language's examples have."""
    bits, labels = sample(docs)
    if not labels:
        return docs.limit(0)
    return predict(docs, fit(bits, labels), known=limits(bits, labels)).filter("lang_pred <> 'und'").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, Jaccard similarity of 0.8 or more) the document with the smallest id stays, once; without any id in a group, each different text stays once."""
    groups = similar_groups(docs, prints=True)
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("id"), F.col("text").alias("text"))
    rows = rows.join(kept, rows["id"].eqNullSafe(kept["kept_id"]), "left_semi").withColumn("unnamed", F.when(F.col("id").isNull(), F.col("text")))
    return rows.dropDuplicates(["id", "unnamed"]).select("doc.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 50 bytes that an earlier document has."""
    return remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources share as their sizes to the power 0.7."""
    return mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of all documents in sequences of 1024. Workers keep fewer ids than alone, as the executors' heaps are full of the stages before."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2, memo=120_000)


STAGES = [("language_id", languages), ("simhash_dedup", near_dedup), ("suffix_dedup", cut_repeats), ("mixing", mix_sources), ("packing", pack)]

#: Encoding, kernels and near-duplicate groups can't be expressed in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = last = written(stage(spark, docs, sf_dir), name, last)  # the table of the stage before is deleted
    return STAGES[-1][1](spark, docs, sf_dir)
