"""From raw documents to a tokenised training mix, in five stages.

Each stage takes what the one before kept; its result is written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm.bpe import digests, encode_documents
from storyloom.llm.common import table
from storyloom.llm.exact import exact_dedup
from storyloom.llm.mixing import mixed_documents
from storyloom.llm.simhash import near_dedup
from storyloom.llm.toxicity import without_toxic
from storyloom.tables import written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted to the labels, does not reject."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with one text, that with the largest id stays."""
    return exact_dedup(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose 3-word SimHash fingerprints link at 2 bits or fewer, that with the smallest id stays."""
    return near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them, in its order."""
    return mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, digests of ids and decoded text of every row."""
    return digests(encode_documents(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact", exact_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

# Toxicity, links of fingerprints and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: tokens and digests of each document of the mix.

    Nulls, repeated rows, ties and empty tables are treated as the stages' operators say;
    an empty table passes through all stages and gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
