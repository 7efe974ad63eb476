"""Exact vector retrieval over chunks: top k, thresholds, filters with a fallback, best chunk per document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt
from ..functions.vectors import cosine
from ..providers import Writer, answer, written
from ..schemas import SEARCHABLE
from .relational import real, where

# How many chunks and documents a search gives.
CANDIDATES, DOCUMENTS, CONTEXT_DOCUMENTS = 20, 5, 3


def scored(rows: DataFrame, query: Column, vector: str = "embedding") -> DataFrame:
    return rows.withColumn("similarity", cosine(F.col(vector), query))


def top(rows: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The k most similar rows; of equally similar ones those with the smaller embedding_id. No vector, no place."""
    return rows.filter("similarity IS NOT NULL").orderBy(F.col("similarity").desc(), "embedding_id").limit(k)


def at_least(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.filter(F.col("similarity") >= threshold)


def eligible(embeddings: DataFrame, documents: DataFrame, classification: DataFrame, document_type: str | None = None, source_type: str | None = None, status: str | None = None, how: str = "inner") -> DataFrame:
    """Searchable chunks with their document and each of its searchable classifications; `how` left: and those without."""
    chunks = embeddings.filter(F.col("embedding").isNotNull() & (F.col("embedding_status") == "generated")).select("embedding_id", "document_id", "chunk_index", "chunk_text", "embedding")
    classes = where(classification.filter(F.col("classification_status").isin(*SEARCHABLE)), document_type=real(document_type), classification_status=real(status)).select("document_id", "classification_id", "document_type", "classification_status")
    return chunks.join(where(documents, source_type=real(source_type)).select("document_id", "file_name", "source_type", "processing_status"), "document_id").join(classes, "document_id", how)


def best_chunks(rows: DataFrame, n: int = DOCUMENTS) -> DataFrame:
    """The best chunk of each document, and the n best documents, ranked."""
    w = Window.partitionBy("document_id").orderBy(F.col("similarity").desc(), "embedding_id", "classification_id")
    best = rows.withColumn("k", F.row_number().over(w)).filter("k = 1").orderBy(F.col("similarity").desc(), "embedding_id").limit(n)
    rank = F.row_number().over(Window.orderBy(F.col("similarity").desc(), "embedding_id"))  # n rows
    return best.select(rank.alias("rank"), "document_id", "file_name", "source_type", "document_type", "classification_status", "chunk_index", F.round("similarity", 4).alias("similarity_score"), excerpt(F.col("chunk_text")).alias("excerpt"))


def search(embeddings: DataFrame, documents: DataFrame, classification: DataFrame, query: DataFrame, n: int = DOCUMENTS, **filters: str | None) -> DataFrame:
    """The flagship: top chunks among those eligible, then the best chunk per document.

    query: one row with the vector `query`. Where no chunk has a classification that the filters let pass, all chunks of
    the source count, with their document's state in place of one. Both cases are one pass: classified chunks come
    first, and the others count only if none of those was found.
    """
    rows = scored(eligible(embeddings, documents, classification, how="left", **filters).crossJoin(F.broadcast(query)), F.col("query")).drop("embedding", "query")  # one row
    classified = F.col("classification_id").isNotNull()
    best = rows.filter("similarity IS NOT NULL").orderBy(classified.desc(), F.col("similarity").desc(), "embedding_id", "classification_id").limit(CANDIDATES)
    any_classified = F.max(classified).over(Window.partitionBy(F.lit(0)))  # CANDIDATES rows
    kept = best.withColumn("any", any_classified).filter(classified == F.col("any")).drop("any")
    return best_chunks(kept.withColumn("classification_status", F.coalesce("classification_status", "processing_status")), n)


def context(results: DataFrame, n: int = CONTEXT_DOCUMENTS) -> DataFrame:
    """One row: the text of the n best documents as a model's context."""
    part = F.concat(F.lit("[Source: "), F.coalesce("file_name", F.lit("Unknown")), F.lit(" | Category: "), F.coalesce("document_type", F.lit("Unknown")), F.lit("]\n"), F.trim(F.coalesce("excerpt", F.lit(""))))
    rows = results.filter(F.col("rank") <= n).select("rank", part.alias("part"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n\n---\n\n").alias("context"))


def answered(contexts: DataFrame, make: Callable[[], Writer]) -> DataFrame:
    """question, context, answer, answer_status of rows with a question and its context (see `context`).

    no_sources where the context is empty, of which no model is asked; failed where the model fails.
    """
    known = F.coalesce(F.trim("context"), F.lit("")) != ""
    said = written(contexts.filter(known).select("question", "context"), make, lambda writer, row: answer(writer, row.question or "", row.context), "answer")
    none = contexts.filter(~known).select("question", "context", F.lit(None).cast("string").alias("answer"), F.lit("no_sources").alias("answer_status"))
    return said.withColumn("answer_status", F.when(F.col("answer").isNull(), "failed").otherwise("answered")).unionByName(none)


def inventory(embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    return embeddings.filter(F.col("embedding").isNotNull()).join(documents.select("document_id", "file_name", "source_type"), "document_id").groupBy("document_id", "file_name", "source_type").agg(F.count("chunk_index").alias("chunks"))


def state(embeddings: DataFrame, documents: DataFrame, classification: DataFrame) -> DataFrame:
    """Generated chunks by document and classification, if any: diagnostics of an empty search."""
    rows = embeddings.filter("embedding_status = 'generated'").join(documents.select("document_id", "file_name"), "document_id").join(classification.select("document_id", F.col("document_id").alias("class_document_id"), "classification_status", "document_type"), "document_id", "left")
    return rows.groupBy("file_name", "document_id", "class_document_id", "classification_status", "document_type").agg(F.count("chunk_index").alias("chunk_count"))
