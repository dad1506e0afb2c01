"""One query per operator over the whole of its table, and SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from tabsight.llm import (bpe, byte_cnn, chat, decontaminate, language_id, license_scan, ngram_join, quality_rules, sharding,
                          simplex_clusters, spelling, toxicity, url_rules)
from tabsight.llm.common import read, train_split

HOST_RULES = tuple(url_rules.HostRule(*r) for r in (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/")))


DELETE_ONE_IN = 199  # of op12: of so many runs of letters one loses a code point
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
                                  "conv_id long, turn long, role string, text string")
    return chat.digests(chat.read_back(*chat.pack(turns.union(extra))))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, keep=["doc_id"])
    back = bpe.decode(coded, VOCABULARY, public_tokenizers.PATTERN)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select(
        "__row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.components_by_jaccard(docs).select("doc_id", "n_shingles", "component_id")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", license_scan.scan_column(spark).alias("s"))
    return docs.select("doc_id", "s.n_words", "s.n_base", "s.first_word", "s.last_word",
                       F.array_join("s.base_labels", ",").alias("base_labels"),
                       F.array_join("s.labels", ",").alias("labels"), "s.score",
                       F.size("s.detections").alias("n_detections"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = language_id.learn(docs.where(train_split()))
    found = docs.select("doc_id", (~train_split()).alias("held_out"),
                        language_id.language_column(spark, dictionaries).alias("l"))
    return found.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), "l.score", "l.rejected")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_by_bytes(docs, n_shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark"))


def quality_model(spark: SparkSession, sf_dir: str) -> byte_cnn.ByteCNN:
    """The classifier, trained on the labelled rows that may be learnt from."""
    return byte_cnn.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where(train_split()))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = read(spark, sf_dir, "documents").select(
        "doc_id", (~train_split()).alias("held_out"),
        byte_cnn.score_column(spark, quality_model(spark, sf_dir)).alias("score"))
    return scores.withColumn("predicted", (F.col("score") >= byte_cnn.KEEP_FROM).cast("int"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with the label of the document that the URL's last number names: blocked if that
    document is marked toxic or of low quality."""
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    number = F.regexp_extract("url", r"/([0-9]{1,18})[^/0-9]*$", 1)
    pages = read(spark, sf_dir, "pages").select("url", F.try_to_number(number, F.lit("9" * 18)).cast("long").alias("doc_id"))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return pages.join(labels, "doc_id").select("url", F.when(bad, url_rules.BLOCK).otherwise(url_rules.ALLOW).alias("label"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_rules.mine_rules(page_labels(spark, sf_dir))
    return url_rules.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules, HOST_RULES)


def toxicity_split() -> F.Column:
    """True for rows whose toxicity label may be learnt from: crc32(doc_id as text) mod 3 is not 1."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = toxicity.fit(docs, read(spark, sf_dir, "labels").where(toxicity_split()), toxicity.character_costs(docs))
    scores = docs.select("doc_id", (~toxicity_split()).alias("held_out"), toxicity.score_column(spark, scorer).alias("score"))
    return scores.withColumn("predicted", (F.col("score") >= toxicity.KEEP_FROM).cast("int"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.group(spelling.count_words(docs, one_in=DELETE_ONE_IN))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex_clusters.digests(simplex_clusters.cluster(read(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_license_scans": op5_license_scans,
    "op6_language_id": op6_language_id,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_url_filters": op10_url_filters,
    "op11_toxicity": op11_toxicity,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_centroid_clustering": op13_centroid_clustering,
}
ORACLES = {
    "op3_quality_rules": quality_rules.oracle_sql(),
    "op7_sharding": sharding.oracle_sql(),
    "op12_spelling_variants": spelling.oracle_sql(DELETE_ONE_IN),
    "op13_centroid_clustering": simplex_clusters.oracle_sql(),
}
