"""Thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, licenses, minhash, mixing, neighbors, packing, quality, tokenstore, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measures(_table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.store_documents(_table(spark, sf_dir, "documents"))


def op4_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc.doc_id", "doc.source", "doc.text", F.round("rate", 9).alias("rate"), "copies", "copy", "shuffle_key")


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_quality_rules": op2_quality_rules,
        "op3_token_store": op3_token_store,
        "op4_pivot_near_dedup": op4_pivot_near_dedup,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_language_id": op6_language_id,
        "op7_poisson_mixing": op7_poisson_mixing,
        "op8_warc_archive": op8_warc_archive,
        "op9_chat_rotation": op9_chat_rotation,
        "op10_license_digests": op10_license_digests,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_poisson_mixing": mixing.ORACLE,
        "op9_chat_rotation": chat.ORACLE,
        "op10_license_digests": licenses.oracle(),
    }
