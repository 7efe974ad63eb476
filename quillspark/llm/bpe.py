"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Each word is a row of symbols; the leaves of the tree hold rank and place of each adjacent pair, so the root names the
leftmost pair of lowest rank. A merge changes three leaves at most, each updated in logarithmic time, until the root holds
no mergeable pair. Words are looked up in a bounded cache first, since texts repeat them; the new words of a batch of texts
are merged together, the trees of those of one length side by side in one array.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered, slices

#: Pieces between blanks that a worker remembers; beyond that it starts anew.
CACHE = 400_000
#: Text bytes whose new words are merged together; words of a length that are fewer or longer are merged one by one.
BATCH_BYTES, LEAST, LONGEST = 4 << 20, 8, 64
_NONE = 1 << 62
#: What str.split parts at but the vocabulary's blanks don't hold.
_ODD_BLANKS = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where printable in Latin-1, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class PairTree:
    """A segment tree whose root is the smallest of its leaves' values; equal ranks order by place."""

    def __init__(self, values: list[int]) -> None:
        self.size = 1 << max(0, (len(values) - 1).bit_length())
        tree = [_NONE] * self.size + values + [_NONE] * (self.size - len(values))
        for i in range(self.size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.tree = tree

    def root(self) -> int:
        return self.tree[1]

    def put(self, at: int, value: int) -> None:
        tree, i = self.tree, at + self.size
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            i >>= 1
            if other < value:
                value = other
            if tree[i] == value:
                return
            tree[i] = value


class PairForest:
    """The trees of several words of one length, as PairTree has them; all operations are on arrays of words."""

    def __init__(self, values: np.ndarray) -> None:
        count, n = values.shape
        self.levels = max(0, (n - 1).bit_length())
        self.size = 1 << self.levels
        tree = np.full((count, 2 * self.size), _NONE, np.int64)
        tree[:, self.size : self.size + n] = values
        for level in range(self.levels, 0, -1):
            low = 1 << level
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
        self.tree = tree.reshape(-1)

    def roots(self, words: np.ndarray) -> np.ndarray:
        return self.tree[words * (2 * self.size) + 1]

    def put(self, words: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        tree, base, i = self.tree, words * (2 * self.size), at + self.size
        tree[base + i] = values
        for _ in range(self.levels):
            values = np.minimum(values, tree[base + (i ^ 1)])
            i = i >> 1
            tree[base + i] = values


class Bpe:
    """A word-end BPE vocabulary read from a tokenizers file: NFC, lower case, blanks dropped, byte letters."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        splits = [x["pattern"]["Regex"] for x in said["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        self.words = regex.compile(splits[0]).findall
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(merges)}
        codes = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        self.by_code = np.argsort(codes)
        self.codes, self.made = codes[self.by_code], np.array([x for _, x in self.pairs.values()], np.int64)
        letters = byte_letters()
        self.inner = [self.ids[c] for c in letters]
        self.last = [self.ids[c + self.end] for c in letters]
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = Pieces(self)
        self.known: dict[str, list[int]] = {}

    def merge(self, word: str) -> list[int]:
        """The ids of one word, already normalised."""
        raw = word.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        if n == 1:
            return ids
        pairs = self.pairs
        leaf = lambda i, j: r[0] * n + i if (r := pairs.get((ids[i], ids[j]))) else _NONE
        tree = PairTree([leaf(i, i + 1) for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := tree.root()) != _NONE:
            i = best % n
            j = after[i]
            ids[i] = pairs[ids[i], ids[j]][1]
            ids[j] = -1
            after[i] = k = after[j]
            if j < n - 1:
                tree.put(j, _NONE)
            if k < n:
                before[k] = i
                tree.put(i, leaf(i, k))
            else:
                tree.put(i, _NONE)
            if (h := before[i]) >= 0:
                tree.put(h, leaf(h, i))
        return [x for x in ids if x >= 0]

    def merge_all(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Each word with its ids, in any order."""
        lengths: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode()
            lengths.setdefault(len(raw), []).append((word, raw))
        for n, same in lengths.items():
            if n == 1 or n > LONGEST or len(same) < LEAST:
                yield from ((word, self.merge(word)) for word, _ in same)
                continue
            ids = self._merged(np.frombuffer(b"".join(raw for _, raw in same), np.uint8).reshape(-1, n))
            ends = np.cumsum((ids >= 0).sum(axis=1)).tolist()
            left, start = ids[ids >= 0].tolist(), 0
            for (word, _), end in zip(same, ends, strict=True):
                yield word, left[start:end]
                start = end

    def _leaves(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        code = a << 32 | b
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[k] == code, self.by_code[k] * n + at, _NONE)

    def _merged(self, raw: np.ndarray) -> np.ndarray:
        """The ids of words of one length, a row each; -1 where a symbol went into the one before it."""
        count, n = raw.shape
        symbols = np.array(self.inner, np.int64)[raw]
        symbols[:, -1] = np.array(self.last, np.int64)[raw[:, -1]]
        places = np.arange(n)
        forest = PairForest(self._leaves(symbols[:, :-1], symbols[:, 1:], places[:-1], n))
        ids, after, before = symbols.reshape(-1), np.tile(places + 1, count), np.tile(places - 1, count)
        words = np.arange(count)
        while True:
            best = forest.roots(words)
            words, best = words[best != _NONE], best[best != _NONE]
            if not len(words):
                return symbols
            base, i = words * n, best % n
            j = after[base + i]
            ids[base + i] = self.made[best // n]
            ids[base + j] = -1
            after[base + i] = k = after[base + j]
            some = j < n - 1
            forest.put(words[some], j[some], np.full(int(some.sum()), _NONE))
            some = k < n
            leaf = np.full(len(words), _NONE)
            before[base[some] + k[some]] = i[some]
            leaf[some] = self._leaves(ids[base[some] + i[some]], ids[base[some] + k[some]], i[some], n)
            forest.put(words, i, leaf)
            h = before[base + i]
            some = h >= 0
            forest.put(words[some], h[some], self._leaves(ids[base[some] + h[some]], ids[base[some] + i[some]], h[some], n))

    def split(self, piece: str) -> list[str]:
        """The words of what stands between two blanks, normalised."""
        return self.words(piece.lower() if piece.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", piece))))

    def piece(self, piece: str) -> list[int]:
        """The ids of what stands between two blanks."""
        out: list[int] = []
        for word in self.split(piece):
            if (ids := self.known.get(word)) is None:
                if len(self.known) >= CACHE:
                    self.known.clear()
                ids = self.known[word] = self.merge(word)
            out += ids
        return out

    def parts(self, text: str) -> Iterator[str | int]:
        """The pieces of a text, and the ids of special tokens in it."""
        for k, part in enumerate(self.cut.split(text) if self.cut and "<|" in text else [text]):
            if k % 2:
                yield self.special[part]
            else:
                yield from part.split() if not _ODD_BLANKS.search(part) else filter(None, _BLANKS.split(part))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.parts(text):
            out += [part] if isinstance(part, int) else self.piece(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens as the vocabulary writes them, one space between; the file names no decoder that would join them."""
        return " ".join(map(self.names.__getitem__, ids))

    def both(self, text: str) -> tuple[str, str]:
        """The decimal ids joined by one space, and the decoded text."""
        return next(self.both_all([text]))

    def both_all(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """The same of each text, piece by piece through the cache."""
        parts = [None if "<|" in x or _ODD_BLANKS.search(x) else x.split() for x in texts]
        self.pieces.learn(set().union(*filter(None, parts)))
        for text, pieces in zip(texts, parts, strict=True):
            if pieces:
                found = [self.pieces[x] for x in pieces]
                ids, said = " ".join([x for x, _ in found]), " ".join([x for _, x in found])
                if "  " not in ids and ids[:1] != " " and ids[-1:] != " ":  # no piece without tokens
                    yield ids, said
                    continue
            ids = self.encode(text)
            yield " ".join(map(str, ids)), self.decode(ids)


class Pieces(dict):
    """The decimal ids of each piece, joined by spaces, and its decoded form; filled for many pieces at once or at the first look."""

    def __init__(self, bpe: Bpe) -> None:
        super().__init__()
        self.bpe, self.told = bpe, {}  # told: the same of each word

    def __missing__(self, piece: str) -> tuple[str, str]:
        if len(self) >= CACHE:
            self.clear()
        ids = self.bpe.piece(piece)
        out = self[piece] = " ".join(map(str, ids)), self.bpe.decode(ids)
        return out

    def learn(self, pieces: set[str]) -> None:
        """Fill in the pieces that aren't known, half of CACHE at most; the rest is left to the first look."""
        new = list(islice((x for x in pieces if x not in self), CACHE // 2))
        if len(self) + len(new) > CACHE:
            self.clear()
            new = list(islice(pieces, CACHE // 2))
        split, told = [self.bpe.split(x) for x in new], self.told
        words = {x for found in split for x in found}
        if len(told) + len(words) > CACHE:
            told.clear()
        for word, ids in self.bpe.merge_all([x for x in words if x not in told]):
            told[word] = " ".join(map(str, ids)), self.bpe.decode(ids)
        for piece, found in zip(new, split, strict=True):
            self[piece] = told[found[0]] if len(found) == 1 else (" ".join([told[x][0] for x in found]), " ".join([told[x][1] for x in found]))


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    remembered["bpe"] = bpe.cache_clear
    return Bpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of each row; null counts as empty and has no ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe(path).encode(x or "") for x in batch.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids; null counts as no ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe(path).decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(task, "doc_id long, text string")


def encode_report(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; each text is encoded and decoded whole.

    Null counts as empty: no tokens, digests of the empty string. Repeated rows give repeated rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, sha = bpe(path).both_all, hashlib.sha256
        for batch in slices(batches, limit=BATCH_BYTES):
            n, a, b = [], [], []
            for ids, said in both([x or "" for x in batch.column("text").to_pylist()]):
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(sha(ids.encode()).hexdigest())
                b.append(sha(said.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
