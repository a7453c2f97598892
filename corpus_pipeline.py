"""From raw documents to encoded training text, stage by stage.

Each stage is a function of (spark, docs, sf_dir), and all but the last return the columns of
documents. run() applies them to the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftloom.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from driftloom.llm.common import documents, written
from driftloom.llm.queries import FERTILITY, vocabulary


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, tuple(map(vocabulary, FERTILITY)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents of equal text, the one with the largest id stays."""
    return exact_dedup.drop_copies(docs, keep="max")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a Jaccard similarity of 0.8 or more over distinct five-word shingles, the
    one with the smallest id stays.

    SimHash proposes pairs, and the sets of shingles decide. Two sets of similarity 0.8 differ in 15 %
    of their bits: 39 of 256 on average. A radius of 58 proposes such pairs with probability 0.999,
    the buckets with 0.998, and closer ones more surely.
    """
    return simhash.one_of_each(docs, shingle=5, words=4, radius=58, similarity=0.8, distinct=True)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or thinned to the target weights of their sources."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and the hash of its text decoded from them."""
    return bpe.encode(docs, vocabulary(), outputs=("ids", "n_tokens", "decoded_sha256")).select("doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("quality rules", good_documents),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_copies),
    ("mixing", mixed_sources),
    ("bpe encoding", encoded),
]
#: SQL cannot express the stages on word pieces and SimHash; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage keeps is written to the shared folder before the next
    reads it, as stages read their input several times."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
