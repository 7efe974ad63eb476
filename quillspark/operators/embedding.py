"""From classified documents to stored chunks and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import chunks
from ..providers import Embedder, Writer, chunk_context, embedded, written
from ..schemas import CATEGORIES


def embed_documents(documents: DataFrame, make: Callable[[], Embedder], model: str = "offline", writer: Callable[[], Writer] | None = None) -> DataFrame:
    """Rows of document_embeddings for documents (document_id, final_category, chunks: raw sections).

    Categories that aren't searched give one marker (chunk 0, skipped_miscellaneous); documents without chunks one marked
    failed; the others a row for each chunk. With a writer, a sentence of its own that places a chunk in its document
    stands before each chunk's text; chunks that it fails at stay as they are.
    """
    marker = lambda rows, status: rows.select("document_id", F.lit(0).alias("chunk_index"), F.lit("").alias("chunk_text"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(status).alias("embedding_status"))
    wanted = F.coalesce(F.col("final_category").isin(*CATEGORIES), F.lit(False))
    sized = documents.filter(wanted).select("document_id", chunks(F.col("chunks")).alias("c"))
    if writer is None:
        told = sized.withColumn("contexts", F.lit(None).cast("array<string>"))
    else:
        # A document's chunks are asked about together, so that its text isn't sent along with each.
        told = written(sized.select("document_id", "c", F.col("c.text").alias("texts")), writer, _contexts, "contexts", "array<string>")
    pieces = told.select("document_id", "contexts", F.posexplode("c").alias("chunk_index", "c"))
    said, text = F.get("contexts", F.col("chunk_index")), F.col("c.text")
    pieces = pieces.select("document_id", "chunk_index", F.when(said != "", F.concat(said, F.lit("\n\n"), text)).otherwise(text).alias("chunk_text"))
    found = embedded(pieces, make)
    out = found.unionByName(marker(documents.filter(~wanted), "skipped_miscellaneous")).unionByName(marker(sized.filter(F.size("c") == 0), "failed"))
    return out.withColumn("model_name", F.lit(model))


def _contexts(writer: Writer, row) -> list[str]:
    document = "\n\n".join(row.texts)
    return [chunk_context(writer, document, text) for text in row.texts]


def back_reference(classification: DataFrame, embeddings: DataFrame) -> DataFrame:
    """classification with the id of its document's chunk 0, where that is stored."""
    first = embeddings.filter("chunk_index = 0 AND embedding_status = 'generated'").groupBy("document_id").agg(F.min("embedding_id").alias("first_id"))
    return classification.join(first, "document_id", "left").withColumn("embedding_id", F.coalesce("first_id", "embedding_id")).drop("first_id")


def report(embeddings: DataFrame) -> DataFrame:
    """Of each document: chunks in all, stored and failed."""
    return embeddings.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks_total"), F.count_if(F.col("embedding_status") == "generated").alias("chunks_stored"), F.count_if(F.col("embedding_status") == "failed").alias("chunks_failed"))
