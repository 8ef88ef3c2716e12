"""The queries of this subpackage, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dyadspark.llm import exact_dedup, langid, main_text, mixing, packing, quality, repair, simhash, token_counts, warc
from dyadspark.llm.common import small_batches


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _bounded(f) for f in (repair.op1_token_shards, main_text.op2_main_text, exact_dedup.op3_exact_dedup, packing.op4_packing, simhash.op5_simhash, token_counts.op6_token_counts, mixing.op7_mixing, warc.op8_warc, quality.op9_quality, langid.op10_langid)}
ORACLES: dict[str, str] = {"op3_exact_dedup": exact_dedup.OP3_SQL, "op7_mixing": mixing.OP7_SQL, "op8_warc": warc.OP8_SQL, "op9_quality": quality.OP9_SQL}
