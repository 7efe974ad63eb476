"""Files as rows: bytes, extracted text and raw chunks, with a row's failure in its `error` column."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import CHUNK_TYPE
from . import docx, pdf


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file_path, file_name, file_size, content of every file below a path but empty ones (see document_source)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"), "content")


def extract(name: str, data: bytes) -> tuple[str, list[dict], list[dict] | None]:
    """Text and raw chunks of a .pdf, the elements of a .docx; any other kind of file is a ValueError."""
    kind = name.lower().rpartition(".")[2]
    if kind == "docx":
        return "", [], docx.elements(data)
    if kind == "pdf":
        found = pdf.pages(data)
        return pdf.plain_text(found), pdf.sections(found), None
    raise ValueError(f"unsupported file type: {name}")


def attempted(name: str | None, data: bytes | None) -> tuple:
    """text, chunks, elements, error, error_kind of a file, whatever it holds."""
    try:
        return (*extract(name or "", bytes(data) if data is not None else b""), None, None)
    except ValueError as e:
        return "", [], None, str(e), "unsupported"
    except Exception as e:
        return "", [], None, f"{type(e).__name__}: {e}", "failed"


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [attempted(name, data) for name, data in zip(batch.file_name, batch.content, strict=True)]
        yield pd.concat([batch[["file_path", "file_name"]].reset_index(drop=True), pd.DataFrame(rows, columns=["text", "chunks", "elements", "error", "error_kind"])], axis=1)


def extracted(files: DataFrame, strict: bool = False) -> DataFrame:
    """file_path, file_name, text, chunks, error, error_kind. With strict, an unsupported file raises; a broken file never
    does: its text is empty."""
    rows = files.select("file_path", "file_name", "content").mapInPandas(_extracted, f"file_path string, file_name string, text string, chunks {CHUNK_TYPE}, elements {docx.ELEMENTS}, error string, error_kind string")
    return finished(rows, strict)


def finished(rows: DataFrame, strict: bool = False) -> DataFrame:
    """The same of rows that hold the elements of a .docx, as the `documents` source gives them."""
    read = F.col("elements").isNotNull()
    rows = rows.select("file_path", "file_name", F.when(read, docx.plain_text(F.col("elements"))).otherwise(F.col("text")).alias("text"), F.when(read, docx.sections(F.col("elements"))).otherwise(F.col("chunks")).alias("chunks"), "error", "error_kind")
    if strict:
        rows = rows.withColumn("text", F.when(F.col("error_kind") == "unsupported", F.raise_error(F.col("error"))).otherwise(F.col("text")))
    return rows


def write_routed(rows: DataFrame, path: str) -> None:
    """The routing table (document_id, document_type, output_document_path), a folder for each type."""
    rows.write.mode("overwrite").partitionBy("document_type").parquet(path)
