"""N-gram Jaccard join with Bayesian candidate pruning.

1. Candidates. A similar text shares t of its shingles at least. The first (1 - t) of each text's shingles in hash order,
   a fair sample of it, are looked up among all texts'; a text is dropped when the posterior probability that enough of its
   shingles recur elsewhere falls below TOLERANCE. Of the rest all shingles are counted, and of similar texts the first
   (1 - t) in order of rarity must share one: each text is linked to the least text of every recurring shingle among
   those. Every similar pair is in one chain of links, no pair is written, and lines or passages that unlike texts share
   don't join them, being the least rare of what they hold.
2. Pairs. Each cluster's texts meet once with their shingles, in blocks of texts and pairs of blocks. MinHash values
   are compared a few at a time; a pair is dropped when the posterior probability (uniform prior) that it reaches the
   threshold falls below TOLERANCE; the rest are verified exactly. What leaves a task is a link count and one edge per text.
3. Classes. Components of verified links; copies of a text share its class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb
from math import log as _log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOCAL, buffers, mix, packed, partitions, slices, spans, window_hashes, within, word_hashes, written
from .components import components
from .decontamination import _LOWER, WORD

WORDS, THRESHOLD = 5, 0.8
#: A pair is dropped once its chance of reaching the threshold is below this.
TOLERANCE = 1e-9
HASHES, STEP = 64, 16
#: Texts of a block: a sixteenth of their cluster, within these bounds. Small blocks deal a cluster evenly, large ones send
#: the texts of a very large cluster less often.
SMALL_BLOCK, BLOCK = 128, 1024
#: Bytes of texts whose shingles are made at once: a worker's memory is many times that.
SLICE = 2 << 20
#: Share of a prefix's shingles that must be able to recur in other prefixes. Of a similar text THRESHOLD of all shingles
#: recur at least; prefixes of texts of unlike length end at different hashes, hence less.
RECUR = 0.6


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, as (text, hash) sorted by both; a text of fewer words has one of all of them.

    Words are runs of letters, digits and everything beyond ASCII; A-Z are lower-cased.
    """
    data = _LOWER[data]
    starts, ends, firsts = spans(data, offsets, WORD)
    words = word_hashes(data, starts, ends)
    at, text = within(firsts, width)
    hashes = window_hashes(words, width)[at] if len(at) else np.zeros(0, np.uint64)
    n = np.diff(firsts)
    for k in range(1, width):  # short texts, all of one length at a time
        short = np.flatnonzero(n == k)
        if len(short):
            text, hashes = np.concatenate([text, short]), np.concatenate([hashes, mix(window_hashes(words, k)[firsts[short]] + np.uint64(k))])
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


def least_matches(threshold: float, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> list[tuple[int, int]]:
    """(n, m): after n equal-or-not comparisons a pair with fewer than m matches is dropped.

    With a uniform prior, P(J >= t | c of n match) is the chance of at most c successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(step, hashes + 1, step):
        total, m = 0.0, 0
        for c in range(n + 1):
            total += comb(n + 1, c) * threshold**c * (1 - threshold) ** (n + 1 - c)
            if total >= tolerance:
                m = c
                break
        out.append((n, m))
    return out


_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, HASHES, np.uint64)


def signatures(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """MinHash values (texts, HASHES) of 32 bits from the (text, hash) pairs; every text must have a shingle."""
    starts = np.searchsorted(text, np.arange(n))
    out = np.zeros((n, HASHES), np.uint32)
    for k in range(HASHES):
        x = hashes * _FACTORS[k] + _TERMS[k]
        out[:, k] = np.minimum.reduceat((mix(x) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def prefix_lengths(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Of a set of so many shingles, the first ones of which a similar set must hold one."""
    return sizes - np.ceil(sizes * threshold - 1e-9).astype(np.int64) + 1


@lru_cache(maxsize=100_000)
def least_recurring(n: int, share: float = RECUR, tolerance: float = TOLERANCE) -> int:
    """The least number of recurring shingles with which a prefix of n is kept; one at least.

    With a uniform prior, the chance that at least `share` of a text's shingles recur, after a sample of n with c that do,
    is the chance of at most c successes in n + 1 trials. The first c is sought whose chance isn't below the tolerance.
    """
    k = np.arange(n + 2)
    ways = np.append(0.0, np.cumsum(np.log(k[1:])))  # logarithms of factorials
    terms = ways[n + 1] - ways - ways[::-1] + k * _log(share) + (n + 1 - k) * _log(1 - share)
    return min(max(int(np.searchsorted(np.logaddexp.accumulate(terms), _log(tolerance))), 1), n)


def _prefix_task(width: int, threshold: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            docs = batch.column("doc_id").to_numpy()
            text, hashes = shingles(*buffers(batch.column("text")), width)
            if not len(text):
                continue
            sizes = np.bincount(text, minlength=len(docs))
            lengths = prefix_lengths(sizes, threshold)
            place = np.arange(len(text)) - (np.cumsum(sizes) - sizes)[text]
            keep = place < lengths[text]
            text, hashes = text[keep], hashes[keep]
            yield pa.RecordBatch.from_arrays([pa.array(docs[text]), pa.array(lengths[text].astype(np.int32)), pa.array(hashes.view(np.int64))], ["doc", "length", "shingle"])

    return task


def promising(docs: DataFrame, width: int, threshold: float, tolerance: float) -> DataFrame:
    """The ids of texts of whose shingles enough may recur; docs: doc_id and text, without nulls.

    A shingle's least and greatest document, combined before they move, tell whether it recurs. The recurring ones are
    written, so that Spark may split the join at a shingle of very many texts (not straight after an aggregate).
    """
    rows = written(docs.mapInArrow(_prefix_task(width, threshold), "doc long, length int, shingle long"), "shingles", few=True)
    recurring = written(rows.groupBy("shingle").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("shingle"), "recurring", few=True)
    found = rows.join(recurring, "shingle", "left_semi").groupBy("doc", "length").agg(F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("int")
    def least(lengths: pd.Series) -> pd.Series:
        return lengths.map({n: least_recurring(n, RECUR * threshold / THRESHOLD, tolerance) for n in lengths.unique()}).astype("int32")

    return found.filter(F.col("n") >= least("length")).select(F.col("doc").alias("id")).distinct()


def candidate_links(sets: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that join all texts of each similar pair; sets: doc_id and sh, its distinct shingles."""
    rows = sets.select("doc_id", F.size("sh").alias("size"), F.explode("sh").alias("shingle"))
    # Written, as is `first` below, so that Spark may split the joins at a shingle of very many texts.
    recurring = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "recurring", few=True)
    # Shingles of one text alone are the rarest: of the others only as many count as the prefix has places left.
    by_doc = Window.partitionBy("doc_id")
    placed = rows.join(recurring, "shingle").select("doc_id", "size", "shingle", F.row_number().over(by_doc.orderBy("n", "shingle")).alias("k"), F.count(F.lit(1)).over(by_doc).alias("others"))
    prefix = F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - 1e-9) + 1
    rows = written(placed.filter(F.col("size") - F.col("others") + F.col("k") <= prefix).select("doc_id", "shingle"), "prefixes", few=True)
    first = written(rows.groupBy("shingle").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("last")).filter("b < last").select("shingle", "b"), "first", few=True)
    return rows.join(first, "shingle").filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()


class _Links:
    """Links found among the texts of one block, or between two blocks."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], marks: np.ndarray, threshold: float, least: list[tuple[int, int]]) -> None:
        self.ids, self.sets, self.marks, self.t, self.least = ids, sets, marks, threshold, least
        self.sizes = np.array([len(x) for x in sets])
        self.n = np.zeros(len(ids), np.int64)
        self.root = list(range(len(ids)))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def compare(self, a: int, others: np.ndarray) -> None:
        """Compare one text with others: by size, by MinHash values a few at a time, then by their shingles."""
        size = self.sizes[a]
        n = self.sizes[others]
        others = others[(np.minimum(n, size) >= self.t * np.maximum(n, size) - 1e-9)]
        matches, done = np.zeros(len(others), np.int64), 0
        for at, m in self.least:
            if not len(others):
                return
            matches += (self.marks[others, done:at] == self.marks[a, done:at]).sum(1)
            keep = matches >= m
            others, matches, done = others[keep], matches[keep], at
        for at in range(0, len(others), 256):
            some = others[at : at + 256]
            held = np.concatenate([self.sets[i] for i in some])
            mine = self.sets[a]
            hit = mine[np.minimum(np.searchsorted(mine, held), len(mine) - 1)] == held
            sizes = self.sizes[some]
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
            linked = some[both >= self.t * (size + sizes - both) - 1e-9]
            self.n[a] += len(linked)
            self.n[linked] += 1
            for i in linked:
                x, y = self.find(a), self.find(int(i))
                self.root[max(x, y)] = min(x, y)


def _pairs_task(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def group(rows: list[tuple]) -> tuple[list, list, list]:
        i, j = rows[0][1], rows[0][2]
        rows.sort(key=lambda r: r[4])
        links = _Links([r[4] for r in rows], [np.sort(np.array(r[5], np.int64)) for r in rows], np.stack([np.frombuffer(r[6], np.uint32) for r in rows]), threshold, least)
        if i == j:
            for a in range(len(rows) - 1):
                links.compare(a, np.arange(a + 1, len(rows)))
        else:
            right = np.array([k for k, r in enumerate(rows) if r[3] == j], np.int64)
            for a, r in enumerate(rows):
                if r[3] == i:
                    links.compare(a, right)
        found = [k for k in range(len(rows)) if links.n[k]]
        return [links.ids[k] for k in found], [links.ids[links.find(k)] for k in found], [int(links.n[k]) for k in found]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, last = [], ([], [], []), None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "n"])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j", "block", "doc_id", "sh", "marks")), strict=True):
                if r[:3] != last:
                    if held:
                        for x, y in zip(out, group(held), strict=True):
                            x.extend(y)
                    held, last = [], r[:3]
                held.append(r)
            if len(out[0]) > 50_000:
                yield made()
                out = ([], [], [])
        if held:
            for x, y in zip(out, group(held), strict=True):
                x.extend(y)
        yield made()

    return task


def _sets_task(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            text, hashes = shingles(*buffers(batch.column("text")), width)
            have, starts = np.unique(text, return_index=True)
            if not len(have):
                continue
            marks = signatures(np.searchsorted(have, text), hashes, len(have))
            sh = pa.ListArray.from_arrays(pa.array(np.append(starts, len(text)), pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(have)), sh, pa.array([packed(m) for m in marks], pa.binary())], ["doc_id", "sh", "marks"])

    return task


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Copies (sha, rep, n: the least id and number of rows of each distinct text) and links (a, b, n).

    Links have for each text (by its rep) with links the number of them, and an edge to one of its component.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = rows.filter("doc_id is not null")
    copies = written(rows.select("doc_id", F.sha2("text", 256).alias("sha")).groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "copies", few=True)
    # One row for each distinct text: copies have nothing to compare.
    reps = copies.filter("rep is not null").select(F.col("rep").alias("id")).distinct()
    # By key, never broadcast: the ids that are kept grow with the corpus.
    kept = written(promising(known, width, threshold, tolerance).join(reps, "id", "left_semi"), "promising", few=True)
    sets = written(known.join(kept.hint("merge"), F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(_sets_task(width), "doc_id long, sh array<long>, marks binary"), "sets", few=True)
    members = components(candidate_links(sets, threshold))
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = members.join(sizes, "component").select(F.col("node").alias("id"), F.col("component").alias("cluster"), F.ceil(F.col("size") / F.greatest(F.lit(min(SMALL_BLOCK, block)), F.least(F.lit(block), F.ceil(F.col("size") / 16)))).cast("int").alias("blocks"))
    sets = sets.join(members.hint("merge"), F.col("doc_id") == F.col("id")).select("cluster", "blocks", "doc_id", "sh", "marks")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    paired = sets.withColumn("block", mine).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    paired = paired.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "sh", "marks")
    grouped = paired.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return copies, written(grouped.mapInArrow(_pairs_task(threshold, tolerance), "a long, b long, n long"), "links", **LOCAL)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_copies.

    class_id is the least id of the class: texts that a chain of links (Jaccard of five-word shingles at or above the
    threshold) joins, with all their copies. n_links: how many other distinct texts the row's text is linked to;
    n_copies: rows with exactly its text, itself included. Null counts as empty; texts without words have no links, and
    rows of the same such text are copies. A row with a null id is compared with none, but is a copy of equal texts and
    has their class (null if all their ids are). Rows that repeat an id with several texts share that id's class and add
    up its links. An empty table gives no rows.
    """
    copies, links = similar_links(docs, id_col, text_col, **options)
    classes = components(links.select("a", "b"))
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    found = written(counts.join(classes, "node", "left").select("node", "n_links", F.coalesce("component", "node").alias("component")), "classes", few=True)
    groups = copies.join(found, copies["rep"] == found["node"], "left").select("sha", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("n").alias("n_copies"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha"))
    return rows.join(groups, "sha").select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The row with the least id of each class, with all its columns; rows with a null id stay."""
    classes = written(jaccard_classes(docs, id_col, text_col, **options).filter("doc_id <> class_id").select(F.col("doc_id").alias("gone")).distinct(), "gone", few=True)
    # By key, never broadcast: the ids that go grow with the corpus.
    return docs.join(classes.hint("merge"), docs[id_col].cast("long") == classes["gone"], "left_anti")
