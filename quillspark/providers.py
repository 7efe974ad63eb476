"""Model calls behind interfaces. Everything runs offline with the defaults: answers from a column or by a rule."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BATCH = 96


class Embedder(Protocol):
    dims: int

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class Writer(Protocol):
    """A language model: answers, hypothetical documents, context prefixes, classifications as JSON."""

    def write(self, prompt: str, limit: int) -> str: ...


class HashEmbedder:
    """Unit vectors from words' hashes: deterministic, without a model."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for text in texts:
            v = np.zeros(self.dims)
            for w in text.lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "big") % self.dims] += 1 if h[4] & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out


def retried(call: Callable, attempts: int = 3, wait: float = 1.0, most: float = 10.0) -> Callable:
    """The same call, tried again with growing pauses."""

    def again(*args, **kwargs):
        for k in range(attempts):
            try:
                return call(*args, **kwargs)
            except Exception:
                if k == attempts - 1:
                    raise
                time.sleep(min(most, wait * 2**k))

    return again


def embedded(chunks: DataFrame, make: Callable[[], Embedder], text: str = "chunk_text", batch: int = BATCH) -> DataFrame:
    """chunks with embedding and embedding_status, one embedder a task, in slices of `batch`.

    A slice that fails leaves its rows without vectors, marked failed, and the others as they are; so does a vector of
    another size.
    """

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in frames:
            vectors: list = []
            for at in range(0, len(pdf), batch):
                some = pdf[text].iloc[at : at + batch].fillna("").tolist()
                try:
                    vectors += [v if v is not None and len(v) == model.dims else None for v in model.embed(some)]
                except Exception:
                    vectors += [None] * len(some)
            yield pdf.assign(embedding=vectors, embedding_status=["failed" if v is None else "generated" for v in vectors])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name not in ("embedding", "embedding_status"))
    return chunks.drop("embedding", "embedding_status").mapInPandas(task, f"{schema}, embedding array<float>, embedding_status string")


class SourceWriter:
    """Names the sources that a prompt holds: deterministic, without a model."""

    def write(self, prompt: str, limit: int) -> str:
        found = re.findall(r"\[Source: ([^|\]]*) \|", prompt)
        return f"See {', '.join(found)}." if found else ""


def written(rows: DataFrame, make: Callable[[], Writer], ask: Callable, column: str, kind: str = "string") -> DataFrame:
    """rows with a column of what a model says of each, one writer a task; null where it fails after three attempts.

    ask: of a writer and a row (a named tuple) makes the value.
    """

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, said = make(), retried(ask)
        for pdf in frames:
            values: list = []
            for row in pdf.itertuples(index=False):
                try:
                    values.append(said(model, row))
                except Exception:
                    values.append(None)
            yield pdf.assign(**{column: pd.Series(values, index=pdf.index, dtype=object)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != column)
    return rows.drop(column).mapInPandas(task, f"{schema}, `{column}` {kind}")


def prompt_excerpt(text: str, limit: int = 6000) -> str:
    return text[:limit]


def hypothetical_answer(writer: Writer, question: str) -> str:
    """A passage that would answer the question, to search with; the question itself where the model fails."""
    try:
        return writer.write(f"Write a short passage from a business document that answers: {question}", 200).strip() or question
    except Exception:
        return question


def chunk_context(writer: Writer, document: str, chunk: str) -> str:
    """One sentence that places a chunk in its document; empty where the model fails."""
    try:
        return writer.write(f"Document:\n{document[:25_000]}\n\nIn one sentence, place this part in the document:\n{chunk}", 100).strip()
    except Exception:
        return ""


def answer(writer: Writer, question: str, context: str) -> str:
    return writer.write(f"Answer from these sources alone, and cite them.\n\n{context}\n\nQuestion: {question}", 400)


def classify(writer: Writer, text: str, name: str, categories: tuple[str, ...]) -> str | None:
    """A model's answer as JSON text (predicted_category, confidence_score, reasoning), or None after three failures."""
    ask = retried(writer.write)
    try:
        return ask(f"File {name}. Choose one of {', '.join(categories)}, Miscellaneous for this text; answer as JSON with predicted_category, confidence_score (0-100) and reasoning.\n\n{prompt_excerpt(text)}", 300)
    except Exception:
        return None
