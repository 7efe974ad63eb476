"""Token counts for every context limit from one exact histogram of encoded lengths.

Documents are encoded whole and counted by length; suffix sums over the histogram then answer, for any limit L, how many
documents reach it, the tokens of those, what remains after truncation at L, and every quantile. The suffix sums run in
three levels (lengths, blocks of 64, blocks of 4096), so no window holds more than a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
#: Pieces whose counts a worker remembers; beyond that it starts anew.
CACHE = 200_000
_RUN = re.compile(r"\s\s")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter(dict):
    """Tokens of each piece of a text, a piece being a blank and what follows it up to the next."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.encode = _encoding(path).encode_ordinary

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(" " + piece))
        if len(self) >= CACHE:
            self.clear()
        self[piece] = n
        return n

    def count(self, text: str) -> int:
        # The pattern never joins what a single blank parts; only longer runs of blanks depend on their surroundings.
        if _RUN.search(text):
            return len(self.encode(text))
        first, *rest = text.split(" ")
        return len(self.encode(first)) + sum(map(self.__getitem__, rest))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of each row, for the byte-level vocabulary (ranks) at `path`; null counts as empty."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            n = [count(x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, "doc_id long, n_tokens long")


def suffix_sums(histogram: DataFrame, key: str, values: list[str], block: int = BLOCK, levels: int = 2) -> DataFrame:
    """For each row of a histogram with distinct keys, the sums of `values` over this key and all larger: ge_<value>.

    Sums within blocks of keys are added to the suffix sums of the blocks' totals, found the same way.
    """
    at, part = F.floor(F.col(key) / block).cast("long"), f"{key}_block"
    if levels == 0:
        w = Window.orderBy(F.col(key).desc())  # the totals of the largest blocks alone
        return histogram.select("*", *[F.sum(v).over(w).alias(f"ge_{v}") for v in values])
    rows = histogram.withColumn(part, at)
    totals = suffix_sums(rows.groupBy(part).agg(*[F.sum(v).alias(v) for v in values]), part, values, block, levels - 1)
    later = totals.select(part, *[(F.col(f"ge_{v}") - F.col(v)).alias(f"later_{v}") for v in values])
    w = Window.partitionBy(part).orderBy(F.col(key).desc())
    return rows.select("*", *[F.sum(v).over(w).alias(f"ge_{v}") for v in values]).join(later, part).select(*histogram.columns, *[(F.col(f"ge_{v}") + F.col(f"later_{v}")).alias(f"ge_{v}") for v in values])


def token_histogram(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each encoded length that occurs, with all that context limits ask of it.

    n_tokens; n_docs of this length; docs_ge and tokens_ge of documents at least so long; docs_le at most so long;
    truncated_tokens: the corpus after cutting each document at n_tokens; lost_tokens: what that cuts off;
    quantile: the share of documents at most so long. Between two lengths that occur, `truncated_at` interpolates exactly.
    Empty and null texts have length 0; an empty table gives no rows; every row counts, repeated ones too.
    """
    lengths = token_lengths(docs, path, id_col, text_col).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    from .common import written

    histogram = written(lengths, "token-lengths").withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    sums = suffix_sums(histogram, "n_tokens", ["n_docs", "tokens"])
    total = histogram.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    longer = (F.col("ge_tokens") - F.col("tokens")) - F.col("n_tokens") * (F.col("ge_n_docs") - F.col("n_docs"))
    return sums.crossJoin(F.broadcast(total)).select(  # one row
        "n_tokens", "n_docs", F.col("ge_n_docs").alias("docs_ge"), F.col("ge_tokens").alias("tokens_ge"),
        (F.col("all_docs") - F.col("ge_n_docs") + F.col("n_docs")).alias("docs_le"), (F.col("all_tokens") - longer).alias("truncated_tokens"), longer.alias("lost_tokens"),
        ((F.col("all_docs") - F.col("ge_n_docs") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def truncated_at(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left and documents cut when every document is cut at `limit`, from token_histogram()'s rows."""
    return histogram.agg(F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))), F.lit(0)).alias("docs_cut"))
