"""Helpers shared by the training-data operators: shared folders, Arrow plumbing and vectorised words.

Words are found and hashed over whole Arrow buffers with numpy, never one Python object per word.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

#: Bytes hashed at once; keeps the 64-bit temporaries of one slice near 100 MB at most.
SLICE_BYTES = 2 << 20

#: For each file, each checksum file and each folder in a local folder Hadoop starts a chmod, and between fork and exec that
#: process shows the memory of the executor or driver a second time. So no checksum files, nor marks of success.
LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def table(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table(sf_dir, name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str, few: bool = False, **options: str) -> DataFrame:
    """Write to a table in the shared folder and read it back: lineage ends there and lost executors cost nothing.

    few: start few processes on local folders. Partitions are gathered by four, but to two for each core at least, and
    options are LOCAL. Not for what ends in a join that Spark may have to split, or in uneven work.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if few:
        df, options = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, partitions(spark) // 4)), {**LOCAL, **options}
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def as_binary(column: pa.Array) -> pa.Array:
    """Texts as their UTF-8 bytes; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.fill_null(b"") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and their offsets from 0 (one more than texts)."""
    column = as_binary(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` text bytes; a longer text is a batch by itself."""
    for batch in batches:
        column = batch.column(text)
        sizes = np.diff(buffers(column)[1])
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < len(sizes):
            yield batch.slice(start)


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the texts, and for each text the number of its first word (one more than texts).

    is_word: for each of the 256 byte values, whether words hold it. Words never cross texts.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[(offsets < len(data))]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:][offsets[1:] > 0] - 1
    last[cut] = inside[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def byte_values(seed: int) -> np.ndarray:
    """What each byte counts in word_hashes: its number plus 1, or with a seed, 64 random bits."""
    return np.arange(1, 257, dtype=np.uint64) if not seed else np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from differences of polynomial prefix sums modulo 2**64.

    Another seed gives another hash.
    """
    values = byte_values(seed) if seed else None
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE_BYTES)))
        base, top = int(starts[i]), int(ends[j - 1])
        up, down = _power(top - base)
        total = np.zeros(top - base + 1, np.uint64)
        each = data[base:top].astype(np.uint64) + np.uint64(1) if values is None else values[data[base:top]]
        np.cumsum(each * up[: top - base], out=total[1:])
        out[i:j] = (total[ends[i:j] - base] - total[starts[i:j] - base]) * down[starts[i:j] - base]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, width: int, factor: int = 0xA24BAED4963EE407) -> np.ndarray:
    """A hash of each run of `width` consecutive words; runs over the end of a text are for the caller to drop."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out *= np.uint64(factor)
        out += words[k : k + n]
    return mix(out)


def window_counts(firsts: np.ndarray, width: int) -> np.ndarray:
    """How many windows of `width` words each text has."""
    return np.maximum(np.diff(firsts) - width + 1, 0)


def within(firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (among all words) where a window of one text starts, and the text of each."""
    counts = window_counts(firsts, width)
    texts = np.repeat(np.arange(len(counts)), counts)
    offset = np.repeat(firsts[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if len(counts) else np.zeros(0, np.int64)
    return np.arange(len(texts)) + offset, texts


#: What operators remember in this process from task to task, and what makes them forget it.
remembered: dict[str, Callable[[], None]] = {}


def forget_others(operator: str) -> None:
    """Let go of what other operators remember in this process.

    Spark gives an idle Python worker the tasks of the next stage, and what the stage before has filled would stand beside
    what this one needs. For the beginning of a task; results don't depend on it.
    """
    others = [x for x in remembered if x != operator]
    for x in others:
        remembered.pop(x)()
    if others:
        gc.collect()  # what is remembered may point back at itself
    pa.default_memory_pool().release_unused()


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
