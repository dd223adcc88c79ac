"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm import dialogue, language, lines, mixing, quality, simhash, sql, substrings, suffixes, tokens, warc, whitening
from souk.llm.decontaminate import benchmark_hits
from souk.llm.ids import among
from souk.llm.neardup import near_duplicates
from souk.llm.store import fresh, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def byte_bpe(path: str | None = None) -> str:
    """The tokenizer's JSON text; read once on the driver, 1.5 MB whatever the data."""
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    out = benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def language_model(docs: DataFrame) -> language.Model:
    """Learnt from documents that are not held out, about 400 for each language."""
    return language.learn(docs, language.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), train=~held_out())


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = language.predict(docs, language_model(docs))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.without_similar_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh(spark, "tokens")
    tokens.write_tokens(table(spark, folder, "documents"), path, byte_bpe())
    return tokens.checksums(tokens.read_tokens(spark, path))


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substrings.without_repeats(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffixes.without_repeats(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh(spark, "warc")
    warc.write_warc(table(spark, folder, "pages"), path)
    records = warc.read_warc(spark, path)
    again = F.col("record_type") == "revisit"
    return records.select(
        F.when(F.col("record_id") != "", F.col("record_id").cast("bigint")).alias("page_id"),
        F.when(again, F.col("length")).otherwise(F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        F.when(again, F.col("digest")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type",
        F.when(again, F.col("refers_to").cast("bigint")).alias("refers_to"),
    )


def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links")


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def trusted(spark: SparkSession, folder: str) -> DataFrame:
    """All documents labelled as good and not toxic, written once: the fit and the threshold both read them."""
    good = table(spark, folder, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return written(among(table(spark, folder, "documents").select("doc_id", "text"), good), "trusted")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), trusted(spark, folder))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.repair(dialogue.damaged(table(spark, folder, "conversations")), "copies")


def op12_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, folder, "documents"))
    return out.select("doc_id", simhash.hexed().alias("fingerprint"), "component_id")


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    out = whitening.whiten(table(spark, folder, "embeddings"))
    # A sum that a long cannot hold (some millions of vectors) is null here; the operator's decimal has it.
    return out.withColumn("deviation", F.col("deviation").try_cast("bigint"))


QUERIES["op1_language_id"] = op1_language_id
QUERIES["op2_line_dedup"] = op2_line_dedup
QUERIES["op3_token_orc"] = op3_token_orc
QUERIES["op4_substring_dedup"] = op4_substring_dedup
QUERIES["op5_suffix_dedup"] = op5_suffix_dedup
QUERIES["op6_warc_archives"] = op6_warc_archives
ORACLE["op6_warc_archives"] = warc.ORACLE
QUERIES["op7_ngram_jaccard_join"] = op7_ngram_jaccard_join
QUERIES["op8_source_mixing"] = op8_source_mixing
ORACLE["op4_substring_dedup"] = sql.OP4
ORACLE["op5_suffix_dedup"] = sql.OP5
ORACLE["op7_ngram_jaccard_join"] = sql.OP7
ORACLE["op10_benchmark_decontamination"] = sql.OP10
ORACLE["op8_source_mixing"] = mixing.ORACLE
QUERIES["op9_quality_rules"] = op9_quality_rules
QUERIES["op10_benchmark_decontamination"] = op10_benchmark_decontamination
QUERIES["op11_conversation_repair"] = op11_conversation_repair
ORACLE["op11_conversation_repair"] = sql.OP11
QUERIES["op12_simhash_near_dedup"] = op12_simhash_near_dedup
QUERIES["op13_embedding_whitening"] = op13_embedding_whitening
