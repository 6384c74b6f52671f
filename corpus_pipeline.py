"""From raw documents to token ids: five stages, each an operator of the package for training text.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result to the
shared folder and reads it again, so a lost executor costs one stage at most and no plan grows long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mercalith.llm.bpe import encode_documents
from mercalith.llm.common import sf_table, stored
from mercalith.llm.mixing import mixed_documents
from mercalith.llm.quality import accepted
from mercalith.llm.simhash import MAX_BITS, SHINGLE, deduplicated
from mercalith.llm.substrings import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go."""
    return accepted(docs, sf_table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    return deduplicated(docs, SHINGLE, MAX_BITS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that a document of smaller id has too are cut out."""
    return without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix asks for."""
    return mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of the ids and of their decoding."""
    return encode_documents(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", bpe_encoding),
]

# byte-pair encoding and the fingerprints' components have no form in SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = sf_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.split(' ')[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
