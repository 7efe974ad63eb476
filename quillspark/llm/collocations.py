"""Phrase collocation mining with pivot partitioning, as in MG-FSM.

An n-gram belongs to the rarest of its words, its pivot. Around each occurrence of a word a task cuts the fragment in
which this word is the rarest (at most three words to each side, ended by a rarer word, an infrequent one or the end of
the piece), counts equal fragments, and routes them to the word's owner. Owners mine only the n-grams that hold the pivot,
so each occurrence of an n-gram is counted by one owner, once, and long runs of rare words never move.

How rare words are is told by a table of `CELLS` levels of their exact counts (8 MB whatever the corpus), which is all
that is broadcast. Two words may share a cell: then the more frequent one's level holds for both, which routes n-grams
elsewhere but changes no count, since an n-gram's pivot follows from its words alone (the leftmost of the lowest level).
Pivots with very many occurrences have several owners, whose counts are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_binary, buffers, mix, partitions, slices, spans, word_hashes, written

#: Cells of the table of levels, two bytes each, and levels to a doubling of a count.
CELLS, STEPS = 1 << 22, 256
#: Occurrences of a pivot that one owner takes at most, by estimate.
SHARE = 250_000
#: Bytes of text that a task works on at once, and words: longer texts are taken in blocks that overlap.
SLICE, BLOCK = 4 << 20, 1 << 20
#: Fragments that an owner mines at once, but for those of one share, which stay together.
ROWS = 200_000
#: What parts pieces, and what parts the words of a piece.
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
UNKNOWN = "und"

_END = np.zeros(256, bool)
_END[list(ENDS)] = True
_WORD = ~_END
_WORD[list(BLANKS)] = False
_SPACED = np.ones(256, bool)
_SPACED[32] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Block:
    """Some consecutive words of a batch: their dictionary and codes, languages, and the piece of each.

    The words from `low` to `high` are the block's own, the others its neighbours.
    """

    def __init__(self, words: pa.Array, langs: np.ndarray, names: pa.Array, pieces: np.ndarray, low: int, high: int) -> None:
        coded = words.dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.langs, self.names, self.pieces, self.low, self.high = langs, names, pieces, low, high
        # Each word of each language once, and which of them stands at each place.
        self.at, self.pairs = pd.factorize(self.langs * len(self.words) + self.codes)

    def pair_words(self) -> tuple[pa.Array, pa.Array]:
        n = max(len(self.words), 1)
        return self.names.take(pa.array(self.pairs // n)), self.words.take(pa.array(self.pairs % n))


def blocks(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[Block]:
    for batch in slices(batches, limit=SLICE):
        data, offsets = buffers(batch.column("text"))
        data = _LOWER[data]
        starts, ends, firsts = spans(data, offsets, _WORD)
        if not len(starts):
            continue
        marks = np.flatnonzero(_END[data])
        new = np.ones(len(starts), bool)
        new[1:] = np.searchsorted(marks, starts[1:]) != np.searchsorted(marks, ends[:-1])
        new[firsts[firsts < len(starts)]] = True
        pieces = np.cumsum(new)
        letters = data[_WORD[data]].tobytes()
        places = np.concatenate([[0], np.cumsum(ends - starts)])
        names = as_binary(batch.column("lang")).dictionary_encode()
        langs = np.repeat(names.indices.to_numpy().astype(np.int64), np.diff(firsts))
        for low in range(0, len(starts), BLOCK):
            high = min(low + BLOCK, len(starts))
            a, b = max(low - reach, 0), min(high + reach, len(starts))
            words = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((places[a : b + 1] - places[a]).tobytes()), pa.py_buffer(letters[places[a] : places[b]])])
            yield Block(words, langs[a:b], names.dictionary, pieces[a:b], low - a, high - a)


def _text(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary()).cast(pa.large_string()).cast(pa.string())


def cells(names: pa.Array, words: pa.Array, count: int) -> np.ndarray:
    """The cell of each word of a language in the table of levels."""
    hashes = []
    for column in (names, words):
        data, offsets = buffers(column)
        hashes.append(word_hashes(data, offsets[:-1], offsets[1:]))
    return (mix(hashes[0] * np.uint64(0x9E3779B97F4A7C15) + hashes[1]) % np.uint64(count)).astype(np.int64)


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, word and n of each word that occurs `least` times or more; and for each lang one row with no word: all occurrences."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 0):
            names, words = b.pair_words()
            counts, totals = np.bincount(b.at, minlength=len(b.pairs)), np.bincount(b.langs, minlength=len(b.names))
            lang, word = pa.concat_arrays([_text(names), _text(b.names)]), pa.concat_arrays([_text(words), pa.nulls(len(b.names), pa.string())])
            yield pa.RecordBatch.from_arrays([lang, word, pa.array(np.concatenate([counts, totals]))], ["lang", "word", "n"])

    rows = docs.mapInArrow(task, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return rows.filter((F.col("word").isNull() & (F.col("n") > 0)) | (F.col("n") >= least))


def levels(counts: DataFrame, least: int, size: int = CELLS) -> np.ndarray:
    """For each cell the level of its most frequent word, 0 where no frequent word falls: at most `size` rows reach the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level = 1 + np.floor(np.log2(batch.column("n").to_numpy() / least) * STEPS)
            at = cells(batch.column("lang"), batch.column("word"), size)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(level.astype(np.int32))], ["cell", "level"])

    found = counts.filter("word IS NOT NULL").mapInArrow(task, "cell int, level int").groupBy("cell").agg(F.max("level").alias("level")).toArrow()
    out = np.zeros(size, np.uint16)
    out[found.column("cell").to_numpy()] = found.column("level").to_numpy()
    return out


def alike(langs: np.ndarray, columns: list[np.ndarray], many: int) -> tuple[np.ndarray, np.ndarray]:
    """Number the distinct rows of a language and word codes (from -1 to `many` - 1), and give the first place of each."""
    key, bound = langs, int(langs.max()) + 1
    for c in columns:
        if bound * (many + 1) >= 1 << 62:
            key, seen = pd.factorize(key)
            bound = len(seen)
        key, bound = key * (many + 1) + c + 1, bound * (many + 1)
    key, seen = pd.factorize(key)
    first = np.zeros(len(seen), np.int64)
    first[key[::-1]] = np.arange(len(key))[::-1]
    return key, first


def phrased(words: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    """The words of each row, space-joined; none where a code is -1."""
    parts = [words.take(pa.array(np.where(c < 0, 0, c), mask=c < 0)) for c in columns]
    return _text(pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()), null_handling="skip"))


def fragments(docs: DataFrame, table: np.ndarray, longest: int, least: int, share: int) -> DataFrame:
    """lang, pivot, shares, at, fragment and weight: fragments in which the word at place `at` is the rarest."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    reach = longest - 1

    def cut(b: Block) -> pa.RecordBatch | None:
        level = shared.value[cells(*b.pair_words(), len(shared.value))].astype(np.int32)[b.at]
        n = len(level)
        sides = {}
        for side in (-1, 1):
            grow, size = level > 0, np.zeros(n, np.int8)
            for d in range(1, min(reach, n - 1) + 1):
                here, there = (slice(d, n), slice(0, n - d)) if side < 0 else (slice(0, n - d), slice(d, n))
                ok = (b.pieces[here] == b.pieces[there]) & ((level[there] > level[here]) if side < 0 else (level[there] >= level[here]))
                grow[here] &= ok
                grow[: d] &= side > 0
                grow[n - d :] &= side < 0
                size += grow
            sides[side] = size
        keep = (sides[-1] + sides[1]) > 0
        keep[: b.low] = keep[b.high :] = False
        at = np.flatnonzero(keep)
        if not len(at):
            return None
        left, right, columns = sides[-1][at], sides[1][at], []
        for d in range(-reach, reach + 1):
            held = (left >= -d) if d < 0 else (right >= d)
            columns.append(np.where(held, b.codes[np.clip(at + d, 0, n - 1)], -1))
        key, first = alike(b.langs[at], columns, len(b.words))
        about = least * np.exp2((level[at[first]] - 1) / STEPS)
        rows = {
            "lang": _text(b.names.take(pa.array(b.langs[at[first]]))),
            "pivot": _text(b.words.take(pa.array(columns[reach][first]))),
            "shares": pa.array((1 + about // share).astype(np.int32)),
            "at": pa.array(left[first].astype(np.int32)),
            "fragment": phrased(b.words, [c[first] for c in columns]),
            "weight": pa.array(np.bincount(key).astype(np.int64)),
        }
        return pa.RecordBatch.from_pydict(rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, reach):
            rows = cut(b)
            if rows is not None:
                yield rows

    return docs.mapInArrow(task, "lang string, pivot string, shares int, at int, fragment string, weight long")


def _grams(batch: pa.RecordBatch, longest: int, least: int) -> Iterator[pa.RecordBatch]:
    """Count the n-grams that hold their fragment's pivot; those of whole pivots must reach `least`."""
    data, offsets = buffers(batch.column("fragment"))
    starts, ends, firsts = spans(data, offsets, _SPACED)
    places = np.concatenate([[0], np.cumsum(ends - starts)])
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(data[_SPACED[data]].tobytes())]).dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    names = as_binary(batch.column("lang")).dictionary_encode()
    langs, names = names.indices.to_numpy().astype(np.int64), names.dictionary
    at, weights, shared = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "weight", "shared"))
    sizes = np.diff(firsts)
    for k in range(2, longest + 1):
        rows = [np.flatnonzero((at >= back) & (at - back + k <= sizes)) for back in range(k)]
        begin = np.concatenate([firsts[r] + at[r] - back for back, r in enumerate(rows)])
        rows = np.concatenate(rows)
        if not len(rows):
            continue
        columns = [codes[begin + i] for i in range(k)]
        key, first = alike(langs[rows], columns, len(words))
        sums = np.zeros(len(first), np.int64)
        np.add.at(sums, key, weights[rows])
        good = np.flatnonzero((sums >= least) | shared[rows[first]])
        kept = first[good]
        yield pa.RecordBatch.from_arrays([_text(names.take(pa.array(langs[rows[kept]]))), phrased(words, [c[kept] for c in columns]), pa.array(sums[good])], ["lang", "phrase", "a"])


def mined(parts: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, phrase and a, its count, of each n-gram of 2 to `longest` words that occurs `least` times or more.

    Fragments come to their owner sorted by it, so that an owner's stay together. Owners of a whole pivot know their
    n-grams' counts and drop infrequent ones; those of a share pass theirs on.
    """
    share = F.when(F.col("shares") > 1, F.pmod(F.xxhash64("fragment", "at"), F.col("shares"))).otherwise(0).cast("int")
    routed = parts.select(F.xxhash64("lang", "pivot", share).alias("owner"), (F.col("shares") > 1).alias("shared"), "lang", "at", "fragment", "weight")
    routed = routed.repartition("owner").sortWithinPartitions("owner")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < ROWS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            owners = rows.column("owner").to_numpy()
            cut = int(np.searchsorted(owners, owners[-1]))  # the last owner may go on
            held = [rows.slice(cut)]
            if cut:
                yield from _grams(rows.slice(0, cut), longest, least)
        if held:
            yield from _grams(pa.Table.from_batches(held).combine_chunks().to_batches()[0], longest, least)

    counts = routed.mapInArrow(task, "lang string, phrase string, a long")
    return counts.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def _runs(words: Column, shortest: int, longest: int) -> Column:
    """All runs of `shortest` to `longest` words, space-joined."""

    def of(i: Column) -> Column:
        first, last = i + (shortest - 1), F.least(F.size(words) - 1, i + (longest - 1))
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda j: F.array_join(F.slice(words, i + 1, j - i + 1), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - 1), of))


def scored(rows: DataFrame, phrases: DataFrame, words: DataFrame, factor: int) -> DataFrame:
    """Rows of `phrases` with l, r and score of their lowest-scoring cut, the earliest of equal ones."""
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).unionByName(words.select("lang", F.col("word").alias("part"), F.col("n").alias("f")))
    parts = F.split("phrase", " ")
    cuts = rows.select("lang", "phrase", "a", parts.alias("w")).select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    join = lambda x: F.array_join(x, " ")
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.slice("w", F.lit(1), F.col("k"))).alias("head"), join(F.slice("w", F.col("k") + 1, F.size("w"))).alias("tail"))
    heads, tails = (known.select("lang", F.col("part").alias(part), F.col("f").alias(count)) for part, count in (("head", "l"), ("tail", "r")))
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    # Decimals of 38 digits: the product may pass 64 bits.
    score = (F.col("a").cast("decimal(20,0)") * F.lit(factor).cast("decimal(18,0)")).alias("x")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", score).withColumn("score", F.expr("x div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    best = F.min(F.struct("score", "k", "l", "r"))
    return cuts.groupBy("lang", "phrase", "a").agg(best.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def uncovered(phrases: DataFrame, longest: int, percent: int) -> DataFrame:
    """Phrases that no longer phrase holds with at least `percent` in a hundred of their count."""
    w = F.split("phrase", " ")
    long = phrases.select("lang", F.col("a").alias("longer"), w.alias("w")).filter(F.size("w") > 2)
    held = long.select("lang", "longer", F.size("w").alias("n"), F.explode(_runs(F.col("w"), 2, longest - 1)).alias("phrase"))
    held = held.filter(F.size(F.split("phrase", " ")) < F.col("n")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return phrases.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * percent)).drop("longer")


def best(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each lang with their rank: those of each of many parts, and then those of the parts' rows."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.hash("phrase"), F.lit(max(16, partitions(rows.sparkSession))))
    near = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, covered: int = 80, top: int = 2000, factor: int = 2_000_000, text_col: str = "text", lang_col: str = "lang", size: int = CELLS, share: int = SHARE) -> DataFrame:
    """The strongest phrases of each language: lang, rank, phrase, a, l, r, n and score.

    Texts are lower-cased (A to Z) and split at sentence marks and line ends into pieces, pieces at blanks into words. a
    counts a phrase of 2 to `longest` words, n all words of its language; of all ways to cut a phrase in two, l and r
    count the parts where factor * a / (l + r), rounded down, is lowest: its score. Phrases under `least` occurrences don't
    count, nor those that a longer one holds with at least `covered` percent of their occurrences. Ties in score go to
    the larger a, then to the smaller phrase in byte order.

    Null texts count as empty, a null lang as "und"; repeated rows count each time; a table without words gives no rows.
    Other columns are not read. Texts of any length are taken whole, in overlapping blocks.
    """
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    counts = written(word_counts(docs, least), "word-counts")
    phrases = written(mined(fragments(docs, levels(counts, least, size), longest, least, share), longest, least), "phrases")
    words, totals = counts.filter("word IS NOT NULL"), counts.filter("word IS NULL").select("lang", "n")
    rows = best(scored(uncovered(phrases, longest, covered), phrases, words, factor), top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
