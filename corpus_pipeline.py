"""A corpus from raw documents to packed sequences, in stages that are each written and read again.

Stages take and, but for the last, return the columns of documents, extra ones of any
name included. Null and empty texts are rejected by the quality rules; rows without a
doc_id are kept as rows of their own; of repeated rows one is kept; an empty table gives
an empty one. Each stage's docstring says what it does with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismlake.llm.compression import keep_clean
from prismlake.llm.importance import keep_sampled
from prismlake.llm.jaccard import keep_one
from prismlake.llm.mixing import mixed_texts
from prismlake.llm.packing import pack
from prismlake.session import discard, settled

#: Near duplicates in the pipeline: words of a shingle, and similarity in percent.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample keeps; texts without tokens have weight 1."""
    return keep_sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands, fitted to all labelled good ones, none held out; null and empty texts go."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), hold_out=False)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near copies, that of the smallest doc_id; rows without an id stay."""
    return keep_one(docs, NEAR_WORDS, NEAR_PERCENT, 100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, the last copy of a source cut to its budget."""
    return mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix with their places in sequences; each copy is packed for itself."""
    return pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("n-gram jaccard join", deduplicate),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The stages hold models, hashes and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's rows are written before the next reads them, and deleted when that has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        kept = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if number:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
