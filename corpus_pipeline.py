"""The corpus pipeline: documents to packed pieces, stage by stage.

Each stage is written as Parquet and read again as the next one's documents. Null texts and texts
without a letter end at the first stage. Rows that repeat an id are rows of their own: copies of a
text go at the second stage, other texts under the same id stay. Texts are read whole at each
stage, an empty table stays empty, and further columns pass through, whatever their names, up to
packing, which leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dyadspark.llm.common import small_batches, written
from dyadspark.llm.exact_dedup import drop_exact_duplicates
from dyadspark.llm.langid import keep_identified
from dyadspark.llm.mixing import apply_mix
from dyadspark.llm.packing import pack_documents
from dyadspark.llm.similar import drop_similar


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the network learns from the input's own labels."""
    small_batches(spark)
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    small_batches(spark)
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id: shingles of five words, a similarity of 0.8 or more."""
    small_batches(spark)
    return drop_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    small_batches(spark)
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 ids, with their ids."""
    small_batches(spark)
    return pack_documents(docs, with_ids=True, cache_words=50_000)


STAGES = [("language ID", language), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: No SQL twin: a trained network and tokenizer ids have none. tests/llm/test_pipeline.py holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
