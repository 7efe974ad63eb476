"""Chunks of documents and sentences from tables: plain Python over one document, run in Arrow batches."""

from __future__ import annotations

import re
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes in characters.
SIZE, OVERLAP, SMALL, CONTEXT = 800, 150, 80, 25_000
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_LINE_END = re.compile(r"\s*\n\s*")
# Fixed value: what counts as a number or an amount.
_NUMBER = re.compile(r"^\$?[\d,]+\.?\d*%?$")
CHUNK_TYPE = "array<struct<text:string,heading_context:string,chunk_type:string>>"


def windows(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Overlapping windows; the last ends with the text."""
    starts = [0]
    while starts[-1] + size < len(text):
        starts.append(starts[-1] + size - overlap)
    return [text[s : s + size] for s in starts]


def packed(pieces: list[str], between: str, size: int = SIZE) -> list[str]:
    """Pieces joined as long as they fit; a piece that is too long is divided by itself."""
    out: list[str] = []
    open_ = False
    for piece in pieces:
        if len(piece) > size:
            out += divided(piece, size)
            open_ = False
        elif open_ and len(joined := out[-1] + between + piece) <= size:
            out[-1] = joined
        else:
            out.append(piece)
            open_ = True
    return out


def divided(text: str, size: int = SIZE) -> list[str]:
    """At paragraphs if there are several, else at sentences, else in windows."""
    if len(text) <= size:
        return [text]
    for parts, between in ((re.split(r"\n\n+", text), "\n\n"), (_SENTENCE.split(text), " ")):
        if len(parts := [p.strip() for p in parts if p.strip()]) > 1:
            return packed(parts, between, size)
    return windows(text, size)


def normalised(chunks: list[dict]) -> list[dict]:
    """Chunks of at most SIZE characters; a small text chunk joins the one before it unless either is a table.

    Tables never join, so whether a part begins a chunk is told by itself and the part before it alone; runs of parts
    from one beginning to the next are then put together.
    """
    parts = [(piece, c.get("heading_context") or "", c.get("chunk_type") or "text") for c in chunks for piece in divided((c.get("text") or "").strip()) if piece.strip()]
    loose = [kind != "table" for _, _, kind in parts]
    joins = [after and before and len(piece.strip()) < SMALL for before, after, (piece, _, _) in zip([False, *loose], loose, parts)]
    number = accumulate(not j for j in joins)
    runs = (list(run) for _, run in groupby(zip(number, parts), key=lambda x: x[0]))
    out = []
    for (_, (first, context, kind)), *rest in runs:
        text = "\n".join([first.rstrip(), *(piece.strip() for _, (piece, _, _) in rest)]) if rest else first
        out.append({"text": text, "heading_context": context, "chunk_type": kind})
    return out


def chunks(raw: Column) -> Column:
    """array<struct<text, heading_context, chunk_type>> of raw sections of the same type; null gives none."""

    @F.pandas_udf(CHUNK_TYPE)
    def made(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: normalised([dict(x) for x in r]) if r is not None else [])

    return made(raw)


def sections(text: Column) -> Column:
    """A whole text as one raw section."""
    return F.array(F.struct(text.alias("text"), F.lit("").alias("heading_context"), F.lit("text").alias("chunk_type")))


def char_windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The same windows as `windows`, in the JVM: array<string>."""
    step, n = size - overlap, F.length(text)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def full_text(texts: Column, limit: int = CONTEXT) -> Column:
    return F.substring(F.array_join(texts, "\n\n"), 1, limit)


def _numeric(cell: str) -> bool:
    return bool(_NUMBER.match(cell.strip()))


def _pair(label: str, value: str) -> str:
    label = label.rstrip(":").strip()
    return f"{label}: {value}" if label and value else value or label


def table_text(table: list | None) -> str:
    """A table as sentences, by its shape: label and value; header and rows; pairs in a row; or plain values."""
    rows = [r for r in ([("" if c is None else str(c)).strip() for c in row] for row in (table if table is not None else ())) if any(r)]
    if not rows:
        return ""
    wide = max(map(len, rows))
    head = [c for c in rows[0] if c]
    words_first = bool(head) and not any(map(_numeric, head))
    if wide == 2:
        lines = [_pair(r[0], r[1] if len(r) > 1 else "") for r in rows]
    elif words_first and len(rows) > 1 and any(_numeric(c) for c in rows[1] if c):
        lines = [", ".join(_pair(rows[0][i] if i < len(rows[0]) else "", c) for i, c in enumerate(r) if c) for r in rows[1:]]
    elif words_first and wide >= 4 and wide % 2 == 0:
        lines = [", ".join(_pair(r[i], r[i + 1]) for i in range(0, len(r) - 1, 2) if r[i + 1]) for r in rows]
    else:
        lines = [", ".join(c for c in r if c) for r in rows]
    return " ".join(f"{x}." for x in lines if x)


def table_sentences(table: Column) -> Column:
    """Of array<array<string>> cells."""

    @F.pandas_udf("string")
    def made(tables: pd.Series) -> pd.Series:
        return tables.map(table_text)

    return made(table)


def _parted(row: tuple[str, ...]) -> list[list[str]]:
    cells = [_LINE_END.split(cell) for cell in row if cell]
    if all(len(lines) > 1 for lines in cells):
        return [[label, " ".join(value)] for label, *value in cells]
    return [[_LINE_END.sub(" ", cell) for cell in row]]


def unstacked(rows: list[list[str]]) -> list[list[str]]:
    """The rows of a table as a reader sees them.

    Equal cells side by side are one merged cell, and equal rows are one row. Where every filled cell of a row has several
    lines, each is a label over its value and becomes a row by itself; else lines within a cell run on.
    """
    distinct = dict.fromkeys(tuple(cell for cell, _ in groupby(map(str.strip, row))) for row in rows)
    return [line for row in distinct if any(row) for line in _parted(row)]
