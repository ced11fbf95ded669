"""From raw documents to token ids: quality rules, near-duplicates, benchmark
leaks, mixing, binary output.

Every stage is (spark, docs, sf_dir) -> DataFrame; its result is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontaminate, mixing, near_dedup, repetition, token_output
from quadrille.llm.common import fresh_path, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class: five words a shingle, similarity 0.8."""
    return near_dedup.keep_first(docs, near_dedup.Banding(words=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by raked source, language and topic weights."""
    return mixing.keep_sampled(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the ids and returns, read back, doc_id, start, n_tokens and ids_crc32."""
    import public_tokenizers
    path = fresh_path(spark, "pipeline-ids")
    token_output.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.summary(spark, path)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing_sources", mixing_sources), ("token_ids", token_ids)]

#: SQL can express neither edit distances in bands nor the tokenizer; tests/llm compares with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
