"""The corpus pipeline: each stage works on all rows that the stage before it kept.

Quality rules, quality classifier, n-gram Jaccard join, benchmark decontamination and byte-level
BPE encoding, in this order. All stages but the last return the columns of ``documents`` and only
leave rows out; the last returns the token ids. Extra columns are carried through; null texts are
rejected by the first stage, whose base rule asks for words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.llm import bpe, byte_cnn, decontaminate, ngram_join, quality_rules
from tabsight.llm.common import read, stored, train_split

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table."""
    return quality_rules.keep_good(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the operator's threshold. The network learns from the labelled
    rows of the whole table that may be learnt from, as the rules before have left few bad ones."""
    model = byte_cnn.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where(train_split()))
    return docs.where(byte_cnn.score_column(spark, model) >= byte_cnn.KEEP_FROM)


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the first with the smallest id."""
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids``, and whether decoding them gives the text again."""
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    coded = bpe.encode(docs.select("doc_id", "text", digest.alias("digest")), VOCABULARY, public_tokenizers.PATTERN,
                       keep=["doc_id", "digest"])
    back = bpe.decode(coded, VOCABULARY, public_tokenizers.PATTERN)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("ngram_jaccard", ngram_jaccard_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", byte_bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order over ``documents``, each one's rows written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# Trained scores, latent search and tokenisation have no SQL form; tests/llm checks the rows by brute force.
ORACLE_SQL = None
