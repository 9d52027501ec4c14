"""A corpus pipeline: toxicity, line dedup, near-dedup, mixing, tokenisation.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import bpe, line_dedup, minhash, mixing, toxicity
from netloom.llm.common import staged


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.without_toxic(docs, labels)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go, however short and whatever is left; n_chars follows the text."""
    return line_dedup.cleaned(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return minhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken 0 to 3 times, by their source's target."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests, as of op1."""
    import public_tokenizers

    return bpe.encode_decode(docs, bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_boilerplate),
    ("near-dedup", without_copies),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: Nearest neighbours, signatures and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
