"""The corpus pipeline: toxicity filter, exact dedup, near-duplicate join, source mix,
packing. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from anomalens.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from anomalens.llm.queries import SEQUENCE, tokenizer_path
from anomalens.plans.storage import scratch_path

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``; the model is fit as in its own query."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.toxic_score(F.col("text"), model) < TOXIC)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the smallest id stays."""
    return ngram_join.drop_linked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, tokenizer_path(), size=SEQUENCE)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("ngram_join", drop_near_copies),
          ("source_mix", mix_sources), ("packing", pack_sequences)]

# Learned scores, the knapsack and tokenisers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each from the Parquet that the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
