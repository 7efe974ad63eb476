"""Substring deduplication by relative Lempel-Ziv parsing against the indexed blocks of all documents.

Documents are dealt into blocks of about BLOCK_BYTES; every block is both reference and input.

1. Index. It names for a window of WIDTH words the first document that holds it, and the place of the window in that
   document's block. Only windows that can occur twice are indexed: equal windows have equal anchors (the least hash of
   their runs of ANCHOR words), so a first round finds the anchors that two documents hold, and a second exchanges the
   windows with such anchors alone. A block combines its documents before anything moves and gets one answer per hash.
2. Reference text. Each block asks for the words at the places it was told, in cells of CELL words. A cell that many
   blocks want is cut out once and reaches them through an equi-join, which Spark splits where a cell is hot.
3. Parse. Each document is factored greedily: at the first window with a reference, the match is extended word by word
   as far as the reference text goes on alike; the factor is a duplicate span. Windows inside a factor need no look; those
   that cross its end are looked up in turn, so a window that stands elsewhere is found although no factor holds it.

The words decide, not the hashes: a factor's bytes are compared. Where a reference turns out to hold other words (hashes
that collide), nothing is taken from it and the whole parse is made again with other hashes.

What moves is packed: 4 bytes an anchor, 24 bytes a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_binary, buffers, mix, packed, partitions, spans, window_hashes, within, word_hashes, written

WIDTH, ANCHOR = 13, 6
BLOCK_BYTES = 4 << 20
#: Words of a cell of reference text.
CELL = 128
#: Bits that tell windows apart, and how often a parse may be made again with other hashes.
BITS, ATTEMPTS = 96, 4
_LAST = (1 << 63) - 1
WORD = np.ones(256, bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
_SENT = "bucket int, block int, keys binary, more binary, docs binary, places binary, many binary"
_TOLD = "block int, keys binary, more binary, docs binary, refs binary, places binary"
_WANTED = "block int, ref int, cell int"
_CELLS = "ref int, cell int, words binary, cuts binary"
_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,words:int,ref:long>>, doubt int, text string"


def _schema(said: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in said.split(", ")])


class Block:
    """The words and windows of the documents of one block, in an order that every task finds again."""

    def __init__(self, table: pa.Table, width: int, anchor: int, seed: int = 0, bits: int = BITS) -> None:
        table = self.table = table.sort_by([("doc_key", "ascending"), ("text_key", "ascending")])
        self.docs = table.column("doc_key").to_numpy()
        self.data, offsets = buffers(table.column("text"))
        self.starts, self.ends, self.firsts = spans(self.data, offsets, WORD)
        self.width, self.anchor, self.seed, self.bits = width, anchor, seed, bits
        self.at, self.text = within(self.firsts, width)

    @cached_property
    def words(self) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends, self.seed)

    def anchors(self) -> np.ndarray:
        """The least hash of the runs of `anchor` words in each window."""
        least = window_hashes(self.words, self.anchor)
        left, reach = self.width - self.anchor + 1, 1
        while reach < left:
            step = min(reach, left - reach)
            least = np.minimum(least[:-step] if step else least, least[step:])
            reach += step
        return least[self.at]

    def windows(self, some: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """The two parts of the windows' hashes: 64 bits and 32."""
        keys = window_hashes(self.words, self.width)[self.at[some]]
        more = (window_hashes(self.words, self.width, 0x8CB92BA72F3D8DD7)[self.at[some]] >> np.uint64(32)).astype(np.uint32)
        return (keys & np.uint64((1 << min(self.bits, 64)) - 1)), (more & np.uint32((1 << max(self.bits - 64, 0)) - 1))


def _new(*sorted_keys: np.ndarray) -> np.ndarray:
    """Of sorted rows, whether each differs from the one before."""
    new = np.ones(len(sorted_keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], 0)
    return new


def _least_docs(keys: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct key: where it first stands in the smallest doc, and whether several docs hold it."""
    order = np.lexsort((docs, *keys))
    first = np.flatnonzero(_new(*(k[order] for k in keys)))
    last = np.append(first[1:], len(order)) - 1 if len(first) else first
    return order[first], docs[order[first]] != docs[order[last]]


def _rows(schema: str, **columns) -> pa.Table:
    """A table of the named columns; those that aren't given are null."""
    n = len(next(iter(columns.values())))
    return pa.Table.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in _schema(schema)], schema=_schema(schema))


def _parted(by: np.ndarray, arrays: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, list[bytes]]]:
    """The distinct values of `by`, and for each the bytes of its part of every array."""
    order = np.argsort(by, kind="stable")
    named, starts = np.unique(by[order], return_index=True)
    ends = np.append(starts[1:], len(order)) if len(named) else starts
    return named, {c: [packed(a[order[s:e]]) for s, e in zip(starts, ends, strict=True)] for c, a in arrays.items()}


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(keys) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def _join(table: pa.Table, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The arrays that a column's rows hold, one after another, and the row of each entry."""
    parts = [np.frombuffer(x or b"", kind) for x in table.column(column).to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.repeat(np.arange(len(parts)), [len(x) for x in parts])


def _find(keys: np.ndarray, more: np.ndarray, wanted: np.ndarray, wanted_more: np.ndarray) -> np.ndarray:
    """For each wanted pair its place among the sorted pairs (keys, more), or -1."""
    out = np.full(len(wanted), -1, np.int64)
    if not len(keys) or not len(wanted):
        return out
    at = np.searchsorted(keys, wanted)
    starts = np.flatnonzero(_new(keys))
    for k in range(int(np.diff(np.append(starts, len(keys))).max())):
        here = np.minimum(at + k, len(keys) - 1)
        same = (keys[here] == wanted) & (more[here] == wanted_more)
        out[same] = here[same]
    return out


class Reference:
    """The reference text that a block was sent: its cells one after another."""

    def __init__(self, cells: pa.Table, seed: int) -> None:
        ref, cell = (cells.column(c).to_numpy() for c in ("ref", "cell"))
        order = np.lexsort((cell, ref))
        self.code = ref[order].astype(np.int64) << 32 | cell[order]
        cells = cells.take(pa.array(order))
        self.data, offsets = buffers(cells.column("words"))
        self.starts, self.ends, self.firsts = spans(self.data, offsets, WORD)
        self.words = word_hashes(self.data, self.starts, self.ends, seed)
        # Where matches end: at a document's end, and where the next cell is missing.
        cuts, row = _join(cells, "cuts", np.int32)
        gaps = self.firsts[1:][np.append(self.code[1:] != self.code[:-1] + 1, True)] if len(order) else np.zeros(0, np.int64)
        self.stops = np.unique(np.concatenate([cuts + self.firsts[row], gaps, [len(self.words)]]))

    def places(self, refs: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where words stand here, by block and place in it; -1 if their cell wasn't sent."""
        if not len(self.code):
            return np.full(len(refs), -1, np.int64)
        code = refs.astype(np.int64) << 32 | places // CELL
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.firsts[at] + places % CELL, -1)


def common_words(block: Block, at: int, reference: Reference, place: int, most: int) -> int:
    """How many words from `at` on are those of the reference from `place` on."""
    done, step = 0, 16
    while done < most:
        n = min(step, most - done)
        same = block.words[at + done : at + done + n] == reference.words[place + done : place + done + n]
        if not same.all():
            done += int(np.argmin(same))
            break
        done, step = done + n, step * 4
    if not done:
        return 0
    mine = block.data[block.starts[at] : block.ends[at + done - 1]].tobytes()
    theirs = reference.data[reference.starts[place] : reference.ends[place + done - 1]].tobytes()
    if mine != theirs:  # other blanks, or words that only have the same hash
        pairs = zip(mine.split(), theirs.split(), strict=True)
        done = next((k for k, (a, b) in enumerate(pairs) if a != b), done)
    return done


def factors(block: Block, text: int, seeds: np.ndarray, docs: np.ndarray, places: np.ndarray, reference: Reference) -> tuple[list[tuple[int, int, int]], int]:
    """The factors (first word, words, reference document) of one text, and how many references held other words.

    seeds: the windows of the text that have a reference, as first words; docs and places: of each the reference
    document and where in the reference text it stands.
    """
    out, doubt, i = [], 0, 0
    begin, end = int(block.firsts[text]), int(block.firsts[text + 1])
    while i < len(seeds):
        at, place = int(seeds[i]), int(places[i])
        most = 0 if place < 0 else min(end - begin - at, int(reference.stops[np.searchsorted(reference.stops, place, "right")]) - place)
        n = common_words(block, begin + at, reference, place, most)
        if n < block.width:
            doubt, i = doubt + 1, i + 1
            continue
        out.append((at, n, int(docs[i])))
        # The next window to look up is the first that crosses the factor's end.
        i = int(np.searchsorted(seeds, at + n - block.width + 1))
    return out, doubt


def _parse(docs: DataFrame, width: int, block_bytes: int, seed: int, bits: int, texts: bool) -> DataFrame:
    """docs: doc_id and text."""
    anchor = min(ANCHOR, width)
    n = partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(max(1, -(-size // block_bytes), min(n, -(-size // (1 << 20)))))
    # As many partitions and buckets as the data have blocks, so that no task grows with the data.
    buckets = parts = max(n, blocks)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    dealt = docs.select(block.alias("block"), "doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc_key"), F.xxhash64("text").alias("text_key"), "text").repartition(parts, "block")

    def anchors(key: tuple, table: pa.Table) -> pa.Table:
        b = Block(table, width, anchor, seed, bits)
        least, docs_at = b.anchors(), b.docs[b.text]
        run = _new(least, b.text)
        least, docs_at = least[run], docs_at[run]
        first, many = _least_docs([least], docs_at)
        keys = least[first]
        named, sent = _parted(_bucket(keys, buckets), {"keys": (keys >> np.uint64(8)).astype(np.uint32), "many": many})
        return _rows(_SENT, bucket=named, block=[key[0].as_py()] * len(named), **sent)

    def repeated(key: tuple, table: pa.Table) -> pa.Table:
        keys, row = _join(table, "keys", np.uint32)
        many, _ = _join(table, "many", np.bool_)
        order = np.argsort(keys, kind="stable")
        group = np.cumsum(_new(keys[order])) - 1
        twice = (np.bincount(group) > 1) | (np.bincount(group, many[order]) > 0) if len(keys) else np.zeros(0, bool)
        at = np.sort(order[twice[group]])
        named, told = _parted(row[at], {"keys": keys[at]})
        return _rows(_SENT, bucket=[key[0].as_py()] * len(named), block=table.column("block").to_numpy()[named], **told)

    def candidates(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table) or not len(answers):
            return _schema(_SENT).empty_table()
        b = Block(table, width, anchor, seed, bits)
        least = b.anchors()
        wanted, row = _join(answers, "keys", np.uint32)
        named = answers.column("bucket").to_numpy()[row].astype(np.uint64) << np.uint64(32) | wanted
        named.sort()
        code = _bucket(least, buckets).astype(np.uint64) << np.uint64(32) | (least >> np.uint64(8)).astype(np.uint32)
        some = np.flatnonzero(named[np.minimum(np.searchsorted(named, code), len(named) - 1)] == code)
        keys, more = b.windows(some)
        first, many = _least_docs([more, keys], b.docs[b.text[some]])
        held = some[first]
        to, sent = _parted(_bucket(keys[first], buckets), {"keys": keys[first], "more": more[first], "docs": b.docs[b.text[held]], "places": b.at[held].astype(np.int32), "many": many})
        return _rows(_SENT, bucket=to, block=[key[0].as_py()] * len(to), **sent)

    def resolved(key: tuple, table: pa.Table) -> pa.Table:
        keys, row = _join(table, "keys", np.uint64)
        more, docs_at, places, many = (_join(table, c, t)[0] for c, t in (("more", np.uint32), ("docs", np.int64), ("places", np.int32), ("many", np.bool_)))
        if not len(keys):
            return _schema(_TOLD).empty_table()
        block_of = table.column("block").to_numpy()
        order = np.lexsort((places, block_of[row], docs_at, more, keys))
        new = _new(keys[order], more[order])
        group = np.cumsum(new) - 1
        first = order[np.flatnonzero(new)][group]
        twice = (np.bincount(group) > 1) | (np.bincount(group, many[order]) > 0)
        # To a block whose only holder is the first document itself there is nothing to say.
        tell = twice[group] & ((docs_at[first] < docs_at[order]) | many[order])
        at, first = order[tell], first[tell]
        named, told = _parted(row[at], {"keys": keys[at], "more": more[at], "docs": docs_at[first], "refs": block_of[row[first]].astype(np.int32), "places": places[first]})
        return _rows(_TOLD, block=block_of[named], **told)

    def wanted(key: tuple, table: pa.Table) -> pa.Table:
        refs, _ = _join(table, "refs", np.int32)
        places, _ = _join(table, "places", np.int32)
        code = refs.astype(np.int64) << 32
        cells = np.unique(np.concatenate([code | (places + k) // CELL for k in (*range(0, width - 1, CELL), width - 1)]))
        return _rows(_WANTED, block=[key[0].as_py()] * len(cells), ref=cells >> 32, cell=cells & 0xFFFFFFFF)

    def cut_out(key: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(table) or not len(asked):
            return _schema(_CELLS).empty_table()
        b = Block(table, width, anchor)
        cells, words, cuts = asked.column("cell").to_pylist(), [], []
        for c in cells:
            begin, end = c * CELL, min((c + 1) * CELL, len(b.starts))
            inner = np.unique(b.firsts[np.searchsorted(b.firsts, begin, "right") : np.searchsorted(b.firsts, end)])
            edges = [begin, *inner.tolist(), end]
            # A blank ends each cell, so that its last word and the next cell's first one stay apart.
            words.append(b"".join(b.data[b.starts[x] : b.ends[y - 1]].tobytes() + b" " for x, y in zip(edges, edges[1:], strict=False)))
            cuts.append(packed((inner - begin).astype(np.int32)))
        return _rows(_CELLS, ref=[key[0].as_py()] * len(cells), cell=cells, words=words, cuts=cuts)

    out_type = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref", pa.int64())]))), ("doubt", pa.int32()), ("text", pa.string())])

    def parsed(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table):
            return out_type.empty_table()
        b = Block(table, width, anchor, seed, bits)
        seeds, owners, docs_at, place = (np.zeros(0, np.int64) for _ in range(4))
        is_cell = told.column("words").is_valid()
        reference = Reference(told.filter(is_cell), seed)
        keys, _ = _join(told, "keys", np.uint64)
        if len(keys) and len(b.at):
            more, lowest, refs, places = (_join(told, c, t)[0] for c, t in (("more", np.uint32), ("docs", np.int64), ("refs", np.int32), ("places", np.int32)))
            order = np.lexsort((more, keys))
            found = _find(keys[order], more[order], *b.windows())
            at = order[np.maximum(found, 0)]
            seeds = np.flatnonzero((found >= 0) & (lowest[at] < b.docs[b.text]))
            at, owners = at[seeds], b.text[seeds]
            docs_at, place = lowest[at], reference.places(refs[at], places[at])
            seeds = b.at[seeds] - b.firsts[owners]
        bounds = np.searchsorted(owners, np.arange(len(b.docs) + 1))
        removed, digests, spans_made, doubts, kept = [], [], [], [], []
        for i, text in enumerate(as_binary(b.table.column("text")).to_pylist()):
            words = text.split()
            found, doubt, gone = [], 0, 0
            if bounds[i] < bounds[i + 1]:
                mine = slice(bounds[i], bounds[i + 1])
                found, doubt = factors(b, i, seeds[mine], docs_at[mine], place[mine], reference)
                keep = np.ones(len(words), bool)
                for s, k, _ in found:
                    keep[s : s + k] = False
                gone = int(len(words) - keep.sum())
                words = compress(words, keep)
            removed.append(gone)
            doubts.append(doubt)
            spans_made.append([{"start": s, "words": k, "ref": r} for s, k, r in found])
            words = b" ".join(words)
            digests.append(hashlib.sha256(words).hexdigest())
            kept.append(words.decode() if texts else None)
        made = [b.table.column("doc_id"), np.diff(b.firsts), removed, digests, spans_made, doubts, kept]
        return pa.Table.from_arrays([x if isinstance(x, pa.ChunkedArray) else pa.array(x, f.type) for x, f in zip(made, out_type, strict=True)], schema=out_type)

    by_block = lambda: dealt.groupBy("block")
    by_bucket = lambda sent: sent.repartition(parts, "bucket").groupBy("bucket")
    # The rounds read one exchange of the documents: Spark plans it once and reuses it.
    first = by_bucket(by_block().applyInArrow(anchors, _SENT)).applyInArrow(repeated, _SENT)
    second = by_bucket(by_block().cogroup(first.groupBy("block")).applyInArrow(candidates, _SENT)).applyInArrow(resolved, _TOLD)
    # Read three times: by the blocks that it tells, for the cells they want, and for the blocks that have these.
    second = written(second, "references")
    asked = written(second.select("block", "refs", "places").groupBy("block").applyInArrow(wanted, _WANTED), "cells")
    cells = by_block().cogroup(asked.select("ref", "cell").distinct().groupBy("ref")).applyInArrow(cut_out, _CELLS)
    sent = asked.join(cells, ["ref", "cell"]).select("block", "ref", "cell", "words", "cuts")
    told = second.unionByName(sent, allowMissingColumns=True)
    return by_block().cogroup(told.groupBy("block")).applyInArrow(parsed, _OUT)


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES, bits: int = BITS, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and spans (start and number of words, and where from).

    Words are what blanks (space, \\t to \\r) part, unchanged. A word is removed if a window of `width` words that covers
    it also starts in a document with a smaller id; windows are judged on the input. Each span stands as one run in the
    document that it names. Null texts have no words. A null id counts as larger than any other: such a document loses
    what others hold and takes nothing from them. Rows that repeat an id take nothing from each other. Ids may be
    negative. An empty table gives no rows. Other columns are not read, whatever their names.

    bits: of the first attempt's hashes; fewer collide more, which costs another attempt and changes no result.
    texts: also give the column text, the kept words joined by one space.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for attempt in range(ATTEMPTS):
        made = written(_parse(rows, width, block_bytes, attempt, BITS if attempt else bits, texts), "factors")
        if made.filter("doubt > 0").isEmpty():
            return made.drop("doubt") if texts else made.drop("doubt", "text")
    raise RuntimeError(f"windows with different words have equal hashes in each of {ATTEMPTS} attempts")


def remove_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id and text of every row, without its duplicate spans; kept words are joined by one space.

    Null texts give empty ones, null ids stay null, and repeated rows stay as many as they are. Other columns are not
    carried along.
    """
    return duplicate_spans(docs, id_col, text_col, texts=True, **options).select("doc_id", "text")


def substring_report(docs: DataFrame, **options) -> DataFrame:
    return duplicate_spans(docs, **options).select("doc_id", "n_words", "n_removed", "kept_sha256")
