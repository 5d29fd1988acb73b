"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows that its predecessor kept. All but
the last return the columns of ``docs``; the last describes each document from its token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stoa.llm import decontaminate, mixing, shingles, token_codes, toxicity
from stoa.llm.queries import tokenizer_file, toxicity_model
from stoa.session import table, written

ORACLE_SQL = None  # a trained model and whole-text matching: tested against a brute-force version


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold. The model learns from ``docs``' labelled rows that aren't held out."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(model, docs["text"])["score"] < 0.3)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more, that with the smallest id."""
    return shingles.keep_first(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated_by_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, read back from directly addressable token files."""
    return token_codes.token_digest(docs, tokenizer_file())


STAGES = [("toxicity", toxic_out), ("near-duplicates", near_copies_out), ("decontamination", benchmark_out), ("mixing", mix), ("token-ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
