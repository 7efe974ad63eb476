"""Text cleaning, paths, file names and messages as column expressions.

Only the repair of wrongly decoded text needs Python: an Arrow UDF. All else stays in the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The store's name, where paths begin with it.
CONTAINER = "documents"
OUTPUT_ROOT = "DIC"
# The forms that count as page numbers.
PAGE_NUMBER = r"^(\d+|[Pp]age\s+\d+|[-–]\s*\d+\s*[-–]|\d+\s*/\s*\d+|[Pp]g\.?\s*\d+)$"


def _quality(text: str) -> float:
    """The share of printable ASCII and line characters."""
    return sum(" " <= c <= "~" or c in "\n\r\t" for c in text) / len(text) if text else 0.0


def repair_text(text: str | None, mode: str = "reference") -> str | None:
    """Re-decode text whose UTF-8 was read as Latin-1, drop stray A-circumflex, compose (NFC).

    Mode `reference` takes whatever re-decoding raises the share of ASCII, which also deletes lone accents; mode `safe`
    re-decodes only where nothing is lost.
    """
    import re

    if not text:
        return text
    if mode == "reference":
        again = text.encode("latin-1", "ignore").decode("utf-8", "ignore")
        if again and _quality(again) > _quality(text):
            text = again
    else:
        try:
            text = text.encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
    return unicodedata.normalize("NFC", re.sub("\xc2(?=\\s|[^\x00-\x7f])", "", text))


def repair(text: Column, mode: str = "reference") -> Column:
    @F.pandas_udf("string")
    def repaired(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: repair_text(x, mode))

    return repaired(text)


def clean_native(text: Column) -> Column:
    """The cleaning steps after repair: control characters, hyphens at line ends, blanks, lines, quotes and dashes."""
    x = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    x = F.regexp_replace(x, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    lines = F.transform(F.split(x, "\n", -1), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    x = F.regexp_replace(F.array_join(lines, "\n"), r"\n{4,}", "\n\n\n")
    x = F.translate(x, "\u2018\u2019\u201c\u201d\u2014\u2013", "''\"\"--")
    return F.regexp_replace(F.replace(x, F.lit("\u2026"), F.lit("...")), r"(?U)^\s+|\s+$", "")


def clean_text(text: Column, mode: str = "reference") -> Column:
    """All cleaning steps; null and empty stay as they are."""
    return F.when(F.length(text) > 0, clean_native(repair(text, mode))).otherwise(text)


def _path_parts(path: Column, container: str = CONTAINER) -> Column:
    parts = F.split(F.regexp_replace(path, "^/+", ""), "/", -1)
    return F.when((F.element_at(parts, 1) == container) & (F.size(parts) > 1), F.slice(parts, 2, F.size(parts) - 1)).otherwise(parts)


def source_key(path: Column, container: str = CONTAINER) -> Column:
    """Where the source file lies: source/folder/name, or source/name where there is no folder."""
    parts = _path_parts(path, container)
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    return F.when(F.size(parts) >= 3, F.concat_ws("/", first, F.element_at(parts, 2), last)).otherwise(F.concat_ws("/", first, last))


def guid_folder(path: Column, container: str = CONTAINER) -> Column:
    """The folder that a source keeps a file in; null where the file lies directly under its source."""
    parts = _path_parts(path, container)
    return F.when(F.size(parts) >= 3, F.element_at(parts, 2))


def output_key(category: Column, path: Column, container: str = CONTAINER) -> Column:
    return F.concat_ws("/", F.lit(OUTPUT_ROOT), category, source_key(path, container))


def suffix(name: Column) -> Column:
    """The lower-case extension with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(name, r"[^./](\.[^./]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=[^.])\.[^.]+$", "")


def tags(text: Column) -> Column:
    """A comma-separated list as trimmed, non-empty entries."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def supported(name: Column) -> Column:
    """The extension of a readable file; any other raises."""
    kind = suffix(name)
    return F.when(kind.isin(".pdf", ".docx"), kind).otherwise(F.raise_error(F.concat(F.lit("unsupported file type: "), name)))


def excerpt(text: Column, n: int = 500) -> Column:
    return F.substring(F.translate(F.trim(text), "\n", " "), 1, n)


def shortened(text: Column, n: int = 400) -> Column:
    flat = F.translate(F.trim(text), "\n", " ")
    return F.when(F.length(flat) > n, F.concat(F.left(flat, F.lit(n)), F.lit("..."))).otherwise(flat)


def score_bar(score: Column) -> Column:
    return F.repeat(F.lit("█"), F.floor(score * 20).cast("int"))


def page_number(line: Column) -> Column:
    """Whether a line is nothing but a page number."""
    return F.trim(line).rlike(PAGE_NUMBER)


def heading_level(style: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(style, F.lit(""))))
    number = F.regexp_extract(s, r"^heading\s+(\d+)", 1)
    return F.when(number != "", number.cast("int")).when(s.isin("title", "subtitle"), 1).otherwise(0)


def heading_path(stack: Column) -> Column:
    """Up to three headings, at most 120 characters."""
    path = F.array_join(F.filter(F.slice(stack, 1, 3), lambda h: h != ""), " > ")
    return F.when(F.length(path) > 120, F.concat(F.left(path, F.lit(117)), F.lit("..."))).otherwise(path)


def email(text: Column) -> Column:
    return F.lower(F.trim(text))


def timestamp_text(at: Column) -> Column:
    """Date, blank and time, with as many decimals as there are."""
    return at.cast("string")


def iso_text(at: Column) -> Column:
    """Date, T and time; six decimals, or none on the full second."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(at, "SSSSSS") == "000000", whole).otherwise(F.concat(whole, F.date_format(at, ".SSSSSS")))


def percent(score: Column, digits: int = 0) -> Column:
    """A percentage as Python prints it: half to even."""
    return F.format_string(f"%.{digits}f", F.bround(score.cast("double"), digits))
