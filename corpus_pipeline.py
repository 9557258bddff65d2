"""The corpus pipeline: each stage takes all that its predecessor kept, written as Parquet in the shared folder and read again.

Language ID drops what it rejects (texts without a letter, and such in languages that no label knows), near-dedup keeps one document of each group, decontamination drops documents in which a benchmark item leaks, PII is masked, and mixing
gives each document the whole number of copies that its source's target asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duplexa.llm.decontaminate import decontaminate
from duplexa.llm.langid import drop_rejected
from duplexa.llm.mixing import repeated
from duplexa.llm.near_dedup import keep_one
from duplexa.llm.pii import redact
from duplexa.llm.shared import documents, forget, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_rejected(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns and copy, from 1: a row for each copy that the mix takes."""
    return repeated(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("benchmark", benchmark), ("personal_data", personal_data), ("mixing", mixing)]
#: A trained model, hashing and random rounding have no SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:  # what the stage settled on its way goes with it
            after = keep(stage(spark, docs, sf_dir))
        if i:
            forget(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
