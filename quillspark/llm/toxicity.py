"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of each word: its own (an embedding, and how far the labels favour it) and those of its characters (how far the
labels favour its runs of four characters: the most, the mean, and the share that they favour). Both are learnt from
labelled training rows alone. A document is scored over all its overlapping windows of WINDOW words; its score is that of
its most toxic window, so that it doesn't depend on a document's length elsewhere.

Training takes at most SAMPLE_DOCS labelled documents of at most SAMPLE_BYTES bytes (a documented bound: those with the
smallest hash of their id), on the driver. Scoring takes every document whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, forget_others, slices, spans, word_hashes
from .decontamination import _LOWER, WORD

SAMPLE_DOCS = 6000
SAMPLE_BYTES = 32_000
WINDOW, STRIDE = 128, 32
#: Bytes of a run of letters that is a word; longer runs are several.
PIECE = 40
#: Scripts without blanks: Thai, Lao, Tibetan, Myanmar, Khmer, kana, bopomofo and Han.
UNSPACED = ((0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
HIDDEN, WORD_DIMS, ATTENTION = 6, 4, 6
#: Parts of the training texts: what words are favoured by is told to each part's texts by the others.
PARTS = 8
#: Gradient steps, windows in a step, and windows of a text in it: of all its windows those that score highest, as found
#: anew ROUNDS times, since only they move the score of a text.
STEPS, BATCH, TOP, ROUNDS = 400, 64, 2, 4
THRESHOLD = 0.7
#: Bytes of text scored at once; an executor holds what that takes for each of its tasks.
SLICE = 1 << 20
#: z of the lower confidence bound on a word's toxic share.
CONFIDENCE = 2.5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Words:
    """Distinct words of some texts and where they stand."""

    hashes: np.ndarray  # of each distinct word
    grams: np.ndarray  # runs of four characters of all distinct words, one word after another
    gram_starts: np.ndarray  # of each distinct word, and the end
    ids: np.ndarray  # the distinct word at each position
    firsts: np.ndarray  # the first position of each text, and the end


@cache
def _kinds() -> np.ndarray:
    """Of each code point beyond ASCII: 1 if it parts words (blanks, punctuation), 2 if its script has no blanks."""
    kinds = np.zeros(0x110000, np.uint8)
    for a, b in UNSPACED:
        kinds[a : b + 1] = 2
    kinds[[c for c in range(0x80, 0x20000) if unicodedata.category(chr(c))[0] in "ZP" or c in (0x85, 0x200B, 0x2060, 0xFEFF)]] = 1
    return kinds


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths in bytes and kinds of the characters beyond ASCII that part words or whose script has no blanks."""
    at = np.flatnonzero(data >= 0xC2)
    lead = data[at]
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    keep = at + size <= len(data)
    at, lead, size = at[keep], lead[keep].astype(np.int64), size[keep].astype(np.int64)
    code = lead & (0xFF >> (size + 1))
    for k in (1, 2, 3):
        more = size > k
        code[more] = code[more] << 6 | data[at[more] + k] & 0x3F
    kind = _kinds()[np.minimum(code, 0x10FFFF)]
    keep = kind > 0
    return at[keep], size[keep], kind[keep]


def _to_character(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same places, moved on to where a character starts or the word ends."""
    for _ in range(3):
        at = at + ((at < ends) & (data[np.minimum(at, len(data) - 1)] & 0xC0 == 0x80))
    return at


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (one more than texts).

    Words are runs of ASCII letters and digits and of characters beyond ASCII but blanks and punctuation. In scripts
    without blanks every two neighbouring characters are a word. Runs of over PIECE bytes are read in pieces that overlap
    by half.
    """
    at, size, kind = _characters(data)
    spaced = data
    if len(at):
        spaced = data.copy()
        for k in range(4):
            spaced[at[size > k] + k] = 32
    starts, ends, _ = spans(spaced, offsets, WORD)
    long = np.flatnonzero(ends - starts > PIECE)
    if len(long):
        counts = np.ones(len(starts), np.int64)
        counts[long] += -(-(ends[long] - starts[long] - PIECE) // (PIECE // 2))
        k = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        starts, top = np.repeat(starts, counts) + k * (PIECE // 2), np.repeat(ends, counts)
        ends = np.where(k == np.repeat(counts, counts) - 1, top, _to_character(data, np.minimum(starts + PIECE, top), top))
        starts = np.where(k > 0, _to_character(data, starts, top), starts)
    at, size = at[kind == 2], size[kind == 2]
    if len(at):
        text = np.searchsorted(offsets, at, "right")
        joined = (at[1:] == at[:-1] + size[:-1]) & (text[1:] == text[:-1])
        before, after = np.concatenate([[False], joined]), np.concatenate([joined, [False]])
        last = at + size
        last[:-1][joined] = last[1:][joined].copy()
        keep = after | ~before
        starts, ends = np.concatenate([starts, at[keep]]), np.concatenate([ends, last[keep]])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    return starts, ends, np.searchsorted(starts, offsets)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of texts, each read whole; A-Z are lower-cased."""
    data = _LOWER[data]
    starts, ends, firsts = word_spans(data, offsets)
    hashes, first, ids = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    lengths = ends[first] - starts[first]
    padded = np.maximum(lengths + 2, 4)  # a mark at both ends
    ends_at = np.cumsum(padded)
    text = np.zeros(int(ends_at[-1]) + 3 if len(ends_at) else 3, np.uint32)
    begin = ends_at - padded
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    text[np.repeat(begin + 1, lengths) + inner] = data[np.repeat(starts[first], lengths) + inner]
    text[begin], text[begin + lengths + 1] = 94, 36
    codes = (text[:-3] << 24) | (text[1:-2] << 16) | (text[2:-1] << 8) | text[3:]
    counts = padded - 3
    gram_starts = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(begin - gram_starts[:-1], counts) + np.arange(int(gram_starts[-1]))
    return Words(hashes, codes[at].astype(np.uint32), gram_starts, ids.astype(np.int64), firsts)


def windows_of(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first position and the text of every window; the last of a text ends with it, a short text has one."""
    n = np.diff(firsts)
    counts = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(np.int64))
    texts = np.repeat(np.arange(len(n)), counts)
    k = np.arange(len(texts)) - np.repeat(np.cumsum(counts) - counts, counts)
    return firsts[texts] + np.minimum(k * STRIDE, np.maximum(n[texts] - WINDOW, 0)), texts


def _favour(toxic: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """The log of how far at least (lower confidence bound) the toxic share exceeds the usual one; 0 where it doesn't."""
    z, p = CONFIDENCE, toxic / np.maximum(n, 1)
    low = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return np.log(np.maximum(low / share, 1)).astype(np.float32)


@dataclass
class Favours:
    """How far the labels favour each word and each run of four characters, sorted by their codes."""

    word: np.ndarray
    word_value: np.ndarray
    gram: np.ndarray
    gram_value: np.ndarray


def favours(seen: Words, labels: np.ndarray, parts: np.ndarray, count: int) -> tuple[Favours, list[Favours]]:
    """From all training texts, and from those outside of each of `count` parts: a word counts once a document.

    parts: the part of each text.
    """
    share = float(np.clip(labels.mean(), 0.01, 0.9))
    texts_n = len(labels)
    texts = np.repeat(np.arange(texts_n), np.diff(seen.firsts))
    pairs = np.unique(seen.ids * np.int64(texts_n) + texts)
    words, texts = pairs // texts_n, pairs % texts_n

    def counted(keys: np.ndarray, texts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = keys * count + parts[texts]
        return np.bincount(at, minlength=size * count).reshape(size, count), np.bincount(at, labels[texts], minlength=size * count).reshape(size, count)

    by_word = counted(words, texts, len(seen.hashes))
    # Of characters: documents that hold a run, through the distinct words that hold it. Documents are taken some at a
    # time, each whole.
    spread = np.diff(seen.gram_starts)
    codes, inverse = np.unique(seen.grams, return_inverse=True)
    by_gram = np.zeros((len(codes), count)), np.zeros((len(codes), count))
    order = np.argsort(texts, kind="stable")
    edges = np.searchsorted(texts[order], np.arange(texts_n + 1))
    at = 0
    while at < texts_n:
        top = max(at + 1, int(np.searchsorted(edges, edges[at] + 200_000)) - 1)
        w, t = words[order[edges[at] : edges[top]]], texts[order[edges[at] : edges[top]]]
        grams = inverse[np.repeat(seen.gram_starts[w] - (np.cumsum(spread[w]) - spread[w]), spread[w]) + np.arange(int(spread[w].sum()))]
        both = np.unique(grams.astype(np.int64) * texts_n + np.repeat(t, spread[w]))
        for total, more in zip(by_gram, counted(both // texts_n, both % texts_n, len(codes)), strict=True):
            total += more
        at = top

    def of(left_out: int | None) -> Favours:
        (n, toxic), (gn, gtoxic) = ((a.sum(1) - (0 if left_out is None else a[:, left_out]) for a in pair) for pair in (by_word, by_gram))
        value = np.where(n >= 2, _favour(toxic, np.maximum(n, 1), share), 0).astype(np.float32)
        gram_value = np.where(gn >= 3, _favour(gtoxic, np.maximum(gn, 1), share), 0).astype(np.float32)
        return Favours(seen.hashes[value > 0], value[value > 0], codes[gram_value > 0], gram_value[gram_value > 0])

    return of(None), [of(k) for k in range(count)]


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0).astype(np.float32)


def features(seen: Words, by: Favours) -> np.ndarray:
    """Of each distinct word: its favour, and of its characters' the most, the mean and the favoured share."""
    out = np.zeros((len(seen.hashes), 4), np.float32)
    out[:, 0] = _look(by.word, by.word_value, seen.hashes)
    if len(seen.hashes):
        grams = _look(by.gram, by.gram_value, seen.grams)
        n = np.diff(seen.gram_starts)
        out[:, 1] = np.maximum.reduceat(grams, seen.gram_starts[:-1])
        out[:, 2] = np.add.reduceat(grams, seen.gram_starts[:-1]) / n
        out[:, 3] = np.add.reduceat((grams > 0).astype(np.float32), seen.gram_starts[:-1]) / n
    return out


@dataclass
class Network:
    """Weights of both directions side by side; gates are update, reset and candidate."""

    by: Favours
    vocabulary: np.ndarray  # hashes of the words with an embedding, sorted; others have that of index 0
    w: dict[str, np.ndarray] = field(default_factory=dict)
    shift: float = 0.0
    scale: float = 1.0

    @staticmethod
    def start(by: Favours, vocabulary: np.ndarray, rng: np.random.Generator) -> Network:
        d, h = 4 + WORD_DIMS, HIDDEN
        r = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(np.float32)
        w = {"e": r(len(vocabulary) + 1, WORD_DIMS, k=0.1), "x": r(d, 6 * h, k=0.5 / np.sqrt(d) * 2), "xb": np.zeros(6 * h, np.float32)}
        for s in "fb":
            w |= {f"u{s}": r(h, 3 * h, k=0.7 / np.sqrt(h)), f"ub{s}": np.zeros(3 * h, np.float32)}
        w |= {"a": r(2 * h, ATTENTION, k=0.5), "ab": np.zeros(ATTENTION, np.float32), "v": r(ATTENTION, k=0.5), "o": r(2 * h, k=0.5), "ob": np.full(1, -1, np.float32)}
        w["e"][0] = 0
        return Network(by, vocabulary, w)

    def inputs(self, seen: Words) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct word: the input vector and the number of its embedding."""
        if len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, seen.hashes), len(self.vocabulary) - 1)
            number = np.where(self.vocabulary[at] == seen.hashes, at + 1, 0)
        else:
            number = np.zeros(len(seen.hashes), np.int64)
        return np.concatenate([features(seen, self.by), self.w["e"][number]], 1), number

    def run(self, x: np.ndarray, n: np.ndarray | None, keep: bool = False):
        """Logits of windows from their projected inputs x (windows, WINDOW, 6h); n: words of each, if not all are full."""
        w, h, (count, steps, _) = self.w, HIDDEN, x.shape
        states = np.zeros((steps, count, 2 * h), np.float32)
        kept = {}
        for s, side in enumerate("fb"):
            state = np.zeros((count, h), np.float32)
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                xt = x[:, t, 3 * h * s : 3 * h * (s + 1)]
                u = state @ w[f"u{side}"] + w[f"ub{side}"]
                gates = _sigmoid(xt[:, : 2 * h] + u[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                c = np.tanh(xt[:, 2 * h :] + r * u[:, 2 * h :])
                new = c + z * (state - c)
                if n is not None:
                    new = np.where((t < n)[:, None], new, state)
                if keep:
                    kept[side, t] = (state, z, r, c, u[:, 2 * h :])
                state = new
                states[t, :, h * s : h * (s + 1)] = state
        tanh = np.tanh(states @ w["a"] + w["ab"])
        score = tanh @ w["v"]
        if n is not None:
            score = np.where(np.arange(steps)[:, None] < n, score, np.float32(-1e9))
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        if n is not None:
            pooled = pooled * (n > 0)[:, None]
        logit = pooled @ w["o"] + w["ob"][0]
        return (logit, (states, tanh, weight, pooled, kept)) if keep else logit

    def back(self, x: np.ndarray, n: np.ndarray, d: np.ndarray, memory) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights and of the projected inputs, for gradients d of the logits."""
        w, h = self.w, HIDDEN
        states, tanh, weight, pooled, kept = memory
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["o"], g["ob"] = pooled.T @ d, np.array([d.sum()], np.float32)
        dp = d[:, None] * w["o"] * (n > 0)[:, None]
        ds = weight[:, :, None] * dp
        dw = np.einsum("nk,tnk->tn", dp, states)
        dscore = weight * (dw - (weight * dw).sum(0))
        g["v"] = np.einsum("tn,tna->a", dscore, tanh)
        dt = dscore[:, :, None] * w["v"] * (1 - tanh**2)
        g["a"], g["ab"] = np.einsum("tnk,tna->ka", states, dt), dt.sum((0, 1))
        ds += dt @ w["a"].T
        dx = np.zeros_like(x)
        steps = x.shape[1]
        for s, side in enumerate("fb"):
            carry = np.zeros((len(d), h), np.float32)
            for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
                total = carry + ds[t, :, h * s : h * (s + 1)]
                state, z, r, c, uc = kept[side, t]
                real = (t < n)[:, None]
                dn = np.where(real, total, 0)
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (state - c) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], 1)
                dx[:, t, 3 * h * s : 3 * h * (s + 1)] = np.concatenate([dz, dr, dc], 1)
                g[f"u{side}"] += state.T @ du
                g[f"ub{side}"] += du.sum(0)
                carry = np.where(real, dn * z + du @ w[f"u{side}"].T, total)
        return g, dx

    def logits(self, data: np.ndarray, offsets: np.ndarray, batch: int = 512) -> np.ndarray:
        """Of each text, the highest logit of its windows; a text without words has that of an empty window."""
        seen = words_of(data, offsets)
        inputs, _ = self.inputs(seen)
        table = inputs @ self.w["x"] + self.w["xb"]
        starts, texts = windows_of(seen.firsts)
        out = np.full(len(offsets) - 1, -np.inf, np.float32)
        lengths = np.minimum(np.diff(seen.firsts)[texts], WINDOW)
        full = lengths == WINDOW
        short = np.flatnonzero(~full)
        for part, whole in ((np.flatnonzero(full), True), (short[np.argsort(lengths[short], kind="stable")], False)):
            for at in range(0, len(part), batch):
                k = part[at : at + batch]
                place = starts[k][:, None] + np.arange(lengths[k].max())  # short windows of like lengths go together
                if not whole:
                    place = np.minimum(place, starts[k][:, None] + lengths[k][:, None] - 1)
                np.maximum.at(out, texts[k], self.run(table[seen.ids[place]], None if whole else lengths[k]))
        return np.where(np.isneginf(out), self.w["ob"][0], out)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _sigmoid((self.logits(data, offsets).astype(np.float64) - self.shift) * self.scale)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7, steps: int = STEPS) -> Network:
    """Fit a network to labelled texts. What words are favoured by is crossed: for each part of the texts, by the others."""
    rng = np.random.default_rng(seed)
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    labels = labels.astype(np.float64)
    seen = words_of(data, offsets)
    # Parts have as many texts of each class, give or take one.
    part = np.zeros(len(texts), np.int64)
    for y in (0, 1):
        mine = rng.permutation(np.flatnonzero((labels > 0) == y))
        part[mine] = np.arange(len(mine)) % PARTS
    by, others = favours(seen, labels, part, PARTS) if len(texts) else (Favours(*(np.zeros(0, t) for t in (np.uint64, np.float32, np.uint32, np.float32))), [])
    # Embeddings for words of at least three documents' worth of places; the rest share one.
    often = np.bincount(seen.ids, minlength=len(seen.hashes)) >= 12
    net = Network.start(by, seen.hashes[often], rng)
    if not len(texts) or labels.min() == labels.max():
        net.w["o"][:] = 0
        net.w["ob"][0] = 0 if not len(texts) else 4 if labels.min() > 0 else -4
        return net
    crossed = np.stack([features(seen, x) for x in others])
    _, number = net.inputs(seen)
    starts, owner = windows_of(seen.firsts)
    lengths = np.minimum(np.diff(seen.firsts)[owner], WINDOW)
    ids_of = lambda k: seen.ids[np.minimum(starts[k][:, None] + np.arange(WINDOW), (starts[k] + lengths[k] - 1)[:, None])]
    side = part[owner]
    base_of = lambda k, w_ids: crossed[side[k][:, None], w_ids]
    blocks = [np.arange(at, min(at + 4096, len(owner))) for at in range(0, len(owner), 4096)]

    def all_windows() -> np.ndarray:
        """The logit of every window of every text, as scoring would see it."""
        out = np.zeros(len(owner), np.float32)
        for k in blocks:
            w_ids = ids_of(k)
            out[k] = net.run(np.concatenate([base_of(k, w_ids), net.w["e"][number[w_ids]]], 2) @ net.w["x"] + net.w["xb"], lengths[k])
        return out

    def strongest(strength: np.ndarray) -> np.ndarray:
        """The TOP windows of each text, by text."""
        order = np.lexsort((-strength, owner))
        first = np.searchsorted(owner[order], np.arange(len(texts)))
        return order[np.arange(len(order)) - first[owner[order]] < TOP]

    # At first, the windows whose words are favoured most.
    appeal = crossed[:, :, 0] + crossed[:, :, 1]
    chosen = strongest(np.concatenate([appeal[side[k][:, None], ids_of(k)].max(1) for k in blocks] or [np.zeros(0)]) + rng.random(len(owner)) * 1e-3)
    by_text = np.searchsorted(owner[chosen], np.arange(len(texts) + 1))
    toxic, clean = np.flatnonzero((labels > 0) & (np.diff(by_text) > 0)), np.flatnonzero((labels == 0) & (np.diff(by_text) > 0))
    memory = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    per = BATCH // TOP
    for step in range(steps if len(toxic) and len(clean) else 0):
        if step and step % -(-steps // ROUNDS) == 0:
            chosen = strongest(all_windows())
        some = np.concatenate([rng.choice(toxic, per // 3), rng.choice(clean, per - per // 3)])
        k = np.concatenate([chosen[by_text[t] : by_text[t + 1]] for t in some])
        group = np.repeat(np.arange(len(some)), by_text[some + 1] - by_text[some])
        w_ids = ids_of(k)
        inputs = np.concatenate([base_of(k, w_ids), net.w["e"][number[w_ids]]], 2)
        x = inputs @ net.w["x"] + net.w["xb"]
        logit, kept = net.run(x, lengths[k], keep=True)
        best = np.full(len(some), -np.inf, np.float32)
        np.maximum.at(best, group, logit)
        top = logit == best[group]
        d = np.where(top, _sigmoid(logit) - labels[some][group], 0.1 * np.where(labels[some][group] == 0, _sigmoid(logit), 0))
        d = (d / len(some)).astype(np.float32)
        g, dx = net.back(x, lengths[k], d, kept)
        flat = dx.reshape(-1, dx.shape[2])
        g["x"], g["xb"] = inputs.reshape(len(flat), -1).T @ flat, flat.sum(0)
        np.add.at(g["e"], number[w_ids].ravel(), (flat @ net.w["x"][4:].T))
        g["e"][0] = 0
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = 0.02 * min(1, 20 / (step + 1) ** 0.5) * (1 - step / steps) + 1e-4
        for name, grad in g.items():
            m, v = memory[name]
            grad = grad * min(1, 5 / (norm + 1e-9))
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            net.w[name] -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-8)
        net.w["e"] *= 1 - 1e-4
    # The cut between the classes, on the crossed inputs of all windows, as scoring sees them: where F1 is best, in the
    # middle of the gap around it.
    best = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(best, owner, all_windows())
    best = np.where(np.isneginf(best), net.w["ob"][0], best)
    order = np.argsort(-best, kind="stable")
    hit = np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(len(order)) + 1 + labels.sum())
    at = int(np.argmax(f1))
    cut = float(best[order[at]] + best[order[min(at + 1, len(order) - 1)]]) / 2
    net.shift = cut - np.log(THRESHOLD / (1 - THRESHOLD))
    return net


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: bool = True, seed: int = 7) -> Network:
    """Train on a bounded sample of the labelled rows; with held_out, of those whose crc32(id as text) mod 3 is not 1.

    Of an id labelled twice, toxic counts; of an id with several texts, the least in byte order is learnt from.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    if held_out:
        ids = ids.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1)
    ids = ids.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)
    # At most SAMPLE_DOCS rows of two numbers: small enough to broadcast whatever the corpus holds.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text")).orderBy("id")  # of a repeated id, its least text
    texts, marks = [], []
    for r in rows.select("text", "label").toLocalIterator():
        texts.append(r["text"].encode())
        marks.append(r["label"])
    return train(texts, np.array(marks, np.float64), seed)


def score_documents(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and predicted of each row, and the columns `keep` as kept_0, kept_1, ..."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    # Texts go to the workers once, even if they are kept.
    text = f"kept_{keep.index(text_col)}" if text_col in keep else "text"
    columns = [*([F.col(text_col).alias("text")] if text == "text" else []), *[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)]]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *columns, F.lit(0.0).alias("score"))
    schema = rows.drop("text").schema
    names = [f.name for f in schema]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scored(batches, shared.value, names, text)

    return rows.mapInArrow(task, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def scored(batches: Iterator[pa.RecordBatch], network: Network, names: list[str], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The columns `names` of all rows, score filled in from the column `text`."""
    forget_others("toxicity")
    for batch in slices(batches, text, SLICE):
        score = pa.array(network.score(*buffers(batch.column(text))), pa.float64())
        yield pa.RecordBatch.from_arrays([score if c == "score" else batch.column(c) for c in names], names)


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null counts as empty; texts without words score as an empty window does. Labels without an id or a mark are left out;
    of an id labelled twice, toxic counts. Without labels every score is 0.5; with one class only, it is that class's.
    Documents that repeat an id are scored each by its own text.
    """
    scored = score_documents(docs, train_on(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns.

    Null texts count as empty and are scored as an empty window, as are texts without words; repeated rows are kept or go
    together; an empty table gives no rows. Columns may have any names.
    """
    names = docs.columns
    return score_documents(docs, train_on(docs, labels, id_col, text_col), id_col, text_col, tuple(names)).filter("predicted = 0").select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(names)])
