"""A training corpus from raw documents, in five stages; each is written as Parquet and read again by the next.

Toxic documents go, then exact copies, then all but one document of each near-duplicate class, then documents that hold
benchmark text; what is left is encoded and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.bpe import encode_report
from quillspark.llm.common import read, written
from quillspark.llm.decontamination import remove_documents
from quillspark.llm.exact_dedup import keep_first
from quillspark.llm.jaccard_join import keep_one
from quillspark.llm.queries import vocabulary
from quillspark.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_documents(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_report(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: The first stage is a trained model and the last a tokenizer, which SQL can't express.
ORACLE_SQL = None
