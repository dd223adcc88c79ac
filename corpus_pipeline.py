"""From raw documents to token files: every stage is one operator over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from souk.llm import language, mixing, tokens
from souk.llm.decontaminate import without_benchmark
from souk.llm.neardup import one_of_each
from souk.llm.queries import byte_bpe, language_model, table
from souk.llm.store import fresh


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known, all columns; a null language is filled in.

    Texts without letters, null and empty ones too, go. Repeated rows, null keys and ties are judged by the
    text alone. An empty table gives no rows; so does one without any labelled text to learn from.
    """
    return language.accepted(docs, language_model(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, all columns: the smallest key, then the smallest hash of the
    text. Null keys come last. Texts without words all stay. An empty table gives no rows."""
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs, all columns. Null and empty texts, null keys and repeated
    rows stay as they are. An empty table gives no rows."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, all columns. A null source is a source, texts
    without words take nothing, ties queue by key and size. An empty table gives no rows."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; a row with place, length and checksum for each, read from the files.

    A null text counts as empty and has its end id; null keys come first, repeated rows follow each other. An
    empty table gives no rows.
    """
    path = fresh(spark, "pipeline-tokens")
    tokens.write_tokens(docs, path, byte_bpe())
    return tokens.checksums(tokens.read_tokens(spark, path))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: SQL cannot train a model, sign texts or encode tokens; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written as Parquet and read again."""
    docs, folder = table(spark, sf_dir, "documents"), fresh(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
