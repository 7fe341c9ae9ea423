"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extraction, host_rules, langid, minhash, mixing, negatives, packing, quality, ranking, sharding, substrings, token_files, vectors
from .base import is_held_out, utf8_bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = host_rules.host_quality(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate", F.coalesce("host_rejected", F.lit(False)).alias("host_rejected"))


def op2_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    out = sharding.sharded_files(docs)
    return out.select("doc_id", (utf8_bytes(F.col("text")) + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("tokens")


def op9_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(F.col("_key").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    out = quality.score_quality(docs, model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)


def op6_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), least_words=8)


def op8_near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", "kept")


def op10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op12_ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


_ALL = (op1_host_quality, op2_shuffled_shards, op3_quality_scores, op4_token_files, op5_near_duplicates, op6_repeated_spans, op7_packed_sequences, op8_near_duplicate_vectors, op9_mixed_sources, op10_languages, op11_main_text, op12_ranked_documents, op13_hard_negatives)
QUERIES = {f.__name__: f for f in _ALL}
