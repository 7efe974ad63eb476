"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams, scanned over whole documents.

Window hashes of a document are looked up in the sorted hashes of the benchmark's windows; each hit is then verified by
comparing the words themselves. The set is broadcast only up to SET_BYTES of benchmark text; a larger benchmark is cut
into parts of that size, and documents pass through one scan per part, which keeps what was hit so far; each pass but
the last is written to the shared folder, so that no task ever holds two sets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, slices, spans, window_hashes, within, word_hashes, written

WIDTH = 10
#: Benchmark text in one broadcast set; its windows take about 40 bytes a word there, in each Python worker.
SET_BYTES = 16 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Windows:
    """The windows of benchmark items, by their number of words: sorted hashes, and of each where its words stand in the
    items' texts and which items hold it. All in numpy arrays."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WIDTH) -> None:
        self.names = [name for name, _ in items]
        texts = pa.array([(text or "").encode() for _, text in items], pa.large_binary())
        data, offsets = buffers(texts)
        self.data = _LOWER[data]
        starts, ends, firsts = spans(self.data, offsets, WORD)
        hashes = word_hashes(self.data, starts, ends)
        self.starts, self.ends = starts.astype(np.uint32), ends.astype(np.uint32)
        widths = np.minimum(np.diff(firsts), width)
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in map(int, np.unique(widths[widths > 0])):
            at, item = within(firsts, n)
            keep = widths[item] == n
            self.by_width[n] = self._sorted(n, window_hashes(hashes, n)[at[keep]], at[keep], item[keep])

    def words(self, at: int, n: int) -> bytes:
        """n words with one blank between each two; words hold no blanks."""
        return b" ".join(self.data[self.starts[k] : self.ends[k]].tobytes() for k in range(at, at + n))

    def _sorted(self, n: int, hashes: np.ndarray, at: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each different window, by hash: the hash, its first word, and the bounds of its items in the last array."""
        order = np.argsort(hashes, kind="stable")
        hashes, at, item = hashes[order], at[order], item[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        sizes = np.diff(np.append(first, len(hashes)))
        window = np.repeat(np.arange(len(first)), sizes)
        for begin, size in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            # Equal hashes of other words, if there are any, are windows of their own.
            seen = {self.words(int(at[begin]), n): window[begin]}
            for k in range(begin + 1, begin + size):
                window[k] = seen.setdefault(self.words(int(at[k]), n), len(hashes) + k)
        order = np.lexsort((item, window, hashes))
        hashes, at, item, window = hashes[order], at[order], item[order], window[order]
        keep = np.append(True, (window[1:] != window[:-1]) | (item[1:] != item[:-1]))
        hashes, at, item, window = hashes[keep], at[keep], item[keep], window[keep]
        first = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        return hashes[first], at[first].astype(np.uint32), np.append(first, len(window)).astype(np.uint32), item.astype(np.uint32)


def _marked(batch: pa.RecordBatch, windows: Windows, hit: list[np.ndarray | None], items: list[set]) -> tuple[np.ndarray, np.ndarray]:
    """Mark the words of a batch's texts that windows cover; gives the words' counts and each text's first word."""
    data, offsets = buffers(batch.column("text"))
    data = _LOWER[data]
    starts, ends, firsts = spans(data, offsets, WORD)
    hashes = word_hashes(data, starts, ends)
    for width, (keys, place, bounds, held) in windows.by_width.items():
        if len(hashes) < width:
            continue
        found = window_hashes(hashes, width)
        near = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        for at in np.flatnonzero(keys[near] == found):
            text = int(np.searchsorted(firsts, at, "right")) - 1
            if at + width > firsts[text + 1]:
                continue
            words = b" ".join(data[starts[k] : ends[k]].tobytes() for k in range(at, at + width))
            k = int(near[at])
            while k < len(keys) and keys[k] == found[at]:
                if windows.words(int(place[k]), width) == words:
                    if hit[text] is None:
                        hit[text] = np.zeros(int(firsts[text + 1] - firsts[text]), bool)
                    hit[text][at - firsts[text] : at - firsts[text] + width] = True
                    items[text].update(windows.names[i] for i in held[bounds[k] : bounds[k + 1]])
                    break
                k += 1
    return np.diff(firsts), starts


def _parts(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's items, one part of at most about `limit` text bytes after another; one part at least."""
    held: list[tuple[str, str | None]] = []
    size = 0
    for r in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        if r[0] is None or r[1] is None:
            continue
        n = len(r[1].encode())
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += n
    yield held


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, set_bytes: int = SET_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_words, hit (the bits of the words hit, or null) and items (sorted ids of items found), and the columns `keep`.

    Words are runs of digits, letters a-z (after lower-casing A-Z) and everything beyond ASCII. An item of fewer words than
    the width is one window; items without words, with null text or null id have none.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)], F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"))
    schema = rows.schema
    for part, items in enumerate(_parts(benchmark, item_col, item_text_col, set_bytes)):
        if part:
            # A pass for each part: tasks hold one set at a time, however large the benchmark is.
            rows = written(rows, "decontamination-pass")
        shared = context.broadcast(Windows(items, width))

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                before = batch.column("hit").to_pylist()
                items = [set(x) for x in batch.column("items").to_pylist()]
                n = batch.column("n_words").to_pylist()
                hit = [None if b is None else np.unpackbits(np.frombuffer(b, np.uint8), count=k).astype(bool) for b, k in zip(before, n, strict=True)]
                counts, _ = _marked(batch, shared.value, hit, items)
                new = {"n_words": pa.array(counts, pa.int64()), "hit": pa.array([None if h is None else np.packbits(h).tobytes() for h in hit], pa.binary()), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

        rows = rows.mapInArrow(task, schema)
    return rows


def decontaminate_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Null texts have no words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [0 if b is None else int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for b in batch.column("hit").to_pylist()]
            items = batch.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([h > 0 for h in hit])], [c.split()[0] for c in _OUT.split(", ")])

    return scan(docs, benchmark, **options).select("doc_id", "n_words", "hit", "items").mapInArrow(task, _OUT)


def remove_documents(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, **options) -> DataFrame:
    """The documents of whose words at most `max_share` are hit, with all their columns."""
    names = docs.columns
    found = scan(docs, benchmark, keep=tuple(names), **options)
    if max_share <= 0:
        clean = found.filter("hit is null")
    else:
        share = F.pandas_udf(lambda h, n: (h.map(lambda b: 0 if b is None else int(np.unpackbits(np.frombuffer(b, np.uint8)).sum())) / n.clip(lower=1)), "double")
        clean = found.filter(share("hit", "n_words") <= max_share)
    return clean.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(names)])


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All documents, with each run of hit words (and what stands between them) cut out of their texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, bits, n in zip(batch.column("text").to_pylist(), batch.column("hit").to_pylist(), batch.column("n_words").to_pylist(), strict=True):
                if bits is None:
                    out.append(text)
                    continue
                hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
                raw = text.encode()
                words = [m.span() for m in _WORDS.finditer(bytes(_LOWER[np.frombuffer(raw, np.uint8)]))]
                parts, at = [], 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                for first, end in zip(edges[::2], edges[1::2], strict=True):
                    parts.append(raw[at : words[first][0]])
                    at = words[end - 1][1]
                out.append(b"".join([*parts, raw[at:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return scan(docs, benchmark, **options).select("doc_id", "text", "n_words", "hit").mapInArrow(task, "doc_id long, text string")
