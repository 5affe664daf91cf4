"""The corpus pipeline: quality rules, language ID, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs.  All but the last return the columns of ``documents``; the last returns the packed
pieces.  An empty table passes every stage; further columns ride along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import langid, minhash, mixing, packing, quality
from loomgraph.llm.workspace import Workspace
from loomgraph.plans import lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and that the rules' posterior calls good (ties stay); null and empty texts go."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the classifier is sure enough of; texts that are null or without letters go."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; rows without id stay, of repeated ids one does."""
    return minhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in shuffled order; null is a source like others."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences; a null text is its end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Expectation-maximisation, the classifier and the tokenizer are beyond SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written to shared storage and read again.

    What a stage wrote on its way goes when its result is written.
    """
    workspace = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        since = lineage.mark()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = workspace.stage(docs, f"stage-{k}")
            lineage.release(spark, since)
            if k:
                workspace.drop(f"stage-{k - 1}")
    return docs
