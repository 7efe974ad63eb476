"""Fill-in-middle transformation: a text is cut at two of its unit ends and its parts are put in another order.

A pandas UDF works on Arrow batches: the regex library's finditer gives the end of each unit, held in a compact array, and
two look-ups there are the cuts. Hashes of seed and id decide cuts and form, so a row's result depends on nothing but its
id and text, wherever and however often it is computed. No row moves between machines.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Settings:
    """How texts are cut. units: a pattern whose matches, one after another, make up a text.

    percent: of how many documents in a hundred the middle is taken out; spm_percent: how many of those put the suffix
    first. Sentinels are distinct, and none starts with what another (or itself) ends with, so that they are found again.
    """

    seed: int = 7
    units: str = r"[^\n]*\n|[^\n]+"
    percent: int = 100
    spm_percent: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or not all(marks) or any(a.endswith(b[:k]) for a in marks for b in marks for k in range(1, len(b) + (a != b))):
            raise ValueError("sentinels must be distinct and must not overlap")


def unit_ends(text: str, units: regex.Pattern) -> array:
    """Where each unit ends, in code points."""
    return array("q", (m.end() for m in units.finditer(text)))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def cut(doc_id: int | None, text: str, s: Settings, units: regex.Pattern) -> tuple:
    """n, form, prefix_chars, middle_chars, output, output_sha256 of one document."""
    ends = unit_ends(text, units)
    n, code = len(ends), hashlib.sha256(f"{s.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(code[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in (s.prefix, s.suffix, s.middle)) or h3 % 100 >= s.percent:
        return n, PLAIN, None, None, text, digest(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    if h4 % 100 < s.spm_percent:
        form, out = SPM, (s.suffix, text[b:], s.prefix, text[:a], s.middle, text[a:b])
    else:
        form, out = PSM, (s.prefix, text[:a], s.suffix, text[b:], s.middle, text[a:b])
    out = "".join(out)
    return n, form, a, b - a, out, digest(out)


def rebuilt(output: str, form: str, s: Settings) -> str:
    """The text that gave this output: its sentinels are the only ones there."""
    if form == PLAIN:
        return output
    first, second = (s.prefix, s.suffix) if form == PSM else (s.suffix, s.prefix)
    head, rest = output[len(first) :].split(second, 1)
    tail, middle = rest.split(s.middle, 1)
    return head + middle + tail if form == PSM else tail + middle + head


_CUT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def fill_in_middle(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, n (units), form, prefix_chars, middle_chars, output and output_sha256 of each row.

    form: plain (the text itself), psm (prefix, suffix, middle, each after its sentinel) or spm (suffix, prefix, middle).
    Null texts count as empty, and empty texts are plain, as are texts that hold a sentinel; a null id counts as no digits.
    Equal rows give equal rows; other columns are left out; an empty table gives no rows. Texts are never shortened.
    """

    @F.pandas_udf(_CUT)
    def transformed(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        units = regex.compile(settings.units)
        rows = [cut(None if pd.isna(i) else int(i), x or "", settings, units) for i, x in zip(ids, texts, strict=True)]
        return pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    # Ids go as text: pandas would make floats of a column with nulls.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.select("doc_id", transformed(F.col("doc_id").cast("string"), F.col("text")).alias("x")).select("doc_id", "x.*")


def restored(transformed: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The columns of fill_in_middle() but the output, with the text rebuilt from output and form, and its digest."""

    @F.pandas_udf("text string, restored_sha256 string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = [rebuilt(o, f, settings) for o, f in zip(outputs, forms, strict=True)]
        return pd.DataFrame({"text": texts, "restored_sha256": list(map(digest, texts))})

    rows = transformed.withColumn("x", back("output", "form"))
    return rows.select(*[c for c in transformed.columns if c != "output"], "x.text", "x.restored_sha256")


def fill_in_middle_report(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of each row."""
    return restored(fill_in_middle(docs, settings, id_col, text_col), settings).drop("text")
