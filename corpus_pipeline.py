"""From raw documents to packed sequences: language, copies, near copies, mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of the documents that they keep. A stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotweave.llm.exact_dedup import drop_copies
from plotweave.llm.langid import keep_identified
from plotweave.llm.mixing import mixed
from plotweave.llm.packing import pack_documents, word_bpe
from plotweave.llm.simhash import drop_near_copies
from plotweave.sources.workspace import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be in a language of the corpus with more than an even guess, whatever
    their label; null texts, those without a letter and those in which nothing is known go."""
    return keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of texts equal but for white space."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of SimHash links."""
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target weights of the sources want it."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in sequences of 4096 tokens."""
    return pack_documents(docs, word_bpe())


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("packing", packing),
]

#: Neither SimHash links nor the rounding, packing and token ids can be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
