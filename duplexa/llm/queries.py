"""The queries of this package's operators by name, with SQL where SQL gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import leaks
from .langid import identify
from .lexical import SQL as LEXICAL_SQL
from .lexical import search
from .licenses import BASE_PHRASES, PHRASES, QUERY_PHRASES
from .licenses import scan as scan_licenses
from .licenses import templates as license_templates
from .mixing import mix
from .near_dedup import SQL as NEAR_SQL
from .near_dedup import near_duplicates
from .negatives import SQL as NEGATIVES_SQL
from .negatives import mine, relabelled, whole_numbers
from .packing import digests, pack
from .pages import extract
from .pii import find_pii
from .preference import SQL as PREFERENCE_SQL
from .preference import paired_by_answer, preference_format
from .quality import judge
from .secrets import scan as scan_secrets
from .shared import documents


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    further = (*(p for p in BASE_PHRASES if p not in QUERY_PHRASES), *PHRASES)
    return scan_licenses(documents(spark, sf_dir), license_templates(spark, QUERY_PHRASES, further))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_format(paired_by_answer(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op5_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


def op6_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op7_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_differencing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(documents(spark, sf_dir)))


def op12_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(relabelled(whole_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))), "vec_id % 50 = 0")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_secret_scan, op3_language_id, op4_preference_format, op5_quality_outliers, op6_minmax_near_dedup, op7_pivotal_mixing, op8_benchmark_leaks, op9_pii, op10_page_text, op11_differencing_pack, op12_impact_search, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op4_preference_format": PREFERENCE_SQL, "op6_minmax_near_dedup": NEAR_SQL, "op12_impact_search": LEXICAL_SQL, "op13_hard_negatives": NEGATIVES_SQL}
