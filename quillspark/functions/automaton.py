"""Many patterns looked for at once: an automaton with goto and failure tables, stepped over whole batches of text.

The patterns' bytes are a trie whose failure links are folded into one table of states by classes of bytes, so that each
byte of text is one look-up, however many patterns there are. Texts are laid out in lanes that overlap by the longest
pattern; a step moves all lanes on by a byte with one numpy operation. Patterns that end at a state are found along its
links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

#: Bytes of one automaton's table at most (more patterns make several), and of text laid out at once.
TABLE, LAID_OUT = 64 << 20, 4 << 20

#: What counts as part of a word, as the JVM's Unicode classes have it.
_WORD = r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]"


@lru_cache(maxsize=1)
def word_points() -> np.ndarray:
    """Whether each code point is part of words."""
    out = np.zeros(0x110000, bool)
    for low in range(0, 0x110000, 0x8000):
        if low != 0xD800:
            text = "".join(chr(c) for c in range(low, low + 0x8000) if not 0xD800 <= c < 0xE000)
            out[[ord(c) for c in regex.findall(_WORD, text)]] = True
    return out


@lru_cache(maxsize=1)
def _any_word() -> regex.Pattern:
    return regex.compile(_WORD)


def holds_word(text: str) -> bool:
    return _any_word().search(text) is not None


@dataclass(frozen=True)
class Automaton:
    """goto: states x classes; classes: of each byte, 0 for bytes of no pattern; own: the pattern that ends at a state, or -1;
    link: the nearest state on the failure path where one ends, or 0; longest: bytes of the longest pattern."""

    goto: np.ndarray
    classes: np.ndarray
    own: np.ndarray
    link: np.ndarray
    longest: int

    @staticmethod
    def of(patterns: list[tuple[int, bytes]]) -> Automaton:
        """patterns: distinct, not empty, each with its number."""
        classes = np.zeros(256, np.uint8 if len({b for _, p in patterns for b in p}) < 256 else np.uint16)
        used = sorted({b for _, p in patterns for b in p})
        classes[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        own = [-1]
        for number, pattern in patterns:
            at = 0
            for c in classes[list(pattern)].tolist():
                if (new := children[at].get(c)) is None:
                    new = children[at][c] = len(children)
                    children.append({})
                    own.append(-1)
                at = new
            own[at] = number
        width = len(used) + 1
        goto, fail, link = np.zeros((len(children), width), np.int32), np.zeros(len(children), np.int32), np.zeros(len(children), np.int32)
        level = [0]
        while level:
            following = []
            for s in level:
                behind = goto[fail[s]].copy() if s else np.zeros(width, np.int32)
                goto[s] = behind
                for c, t in children[s].items():
                    fail[t] = behind[c]
                    goto[s, c] = t
                    f = fail[t]
                    link[t] = f if own[f] >= 0 else link[f]
                    following.append(t)
            level = following
        return Automaton(goto, classes, np.array(own, np.int32), link, max((len(p) for _, p in patterns), default=1))

    def ends(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Where patterns end: places after their last byte, and their numbers. No pattern crosses texts."""
        # A byte of no pattern between texts leads back to the start.
        texts = len(offsets) - 1
        row = np.zeros(len(data) + texts, self.classes.dtype)
        shift = np.repeat(np.arange(texts), np.diff(offsets))
        row[np.arange(len(data)) + shift] = self.classes[data]
        starts = offsets[1:] + np.arange(texts)  # the places of those bytes
        over = self.longest - 1
        step = max(4 * over, int(np.sqrt(len(row))), 64)
        lanes = -(-len(row) // step)
        laid = np.zeros(over + lanes * step, row.dtype)
        laid[over : over + len(row)] = row
        columns = np.ascontiguousarray(np.lib.stride_tricks.as_strided(laid, (lanes, step + over), (step * laid.itemsize, laid.itemsize)).T)
        table, width = self.goto.ravel(), self.goto.shape[1]
        rich = (self.own >= 0) | (self.link > 0)
        state, seen = np.zeros(lanes, np.int64), np.zeros((256, lanes), np.int32)
        for t in range(step + over):
            state = table[state * width + columns[t]].astype(np.int64)
            k = t % 256
            seen[k] = state
            if k == 255 or t == step + over - 1:
                at, lane = np.nonzero(rich[seen[: k + 1]])
                states, at = seen[at, lane], at + (t - k)
                fresh = at >= over  # what ends before is the lane's before
                states, place = states[fresh], lane[fresh] * step + at[fresh] - over
                while len(states):
                    mine = self.own[states] >= 0
                    if mine.any():
                        found = place[mine]
                        yield found + 1 - np.searchsorted(starts, found), self.own[states[mine]]
                    states = self.link[states]
                    on = states > 0
                    states, place = states[on], place[on]


class Matcher:
    """Which of many texts hold which patterns. bounded: patterns that count only between word boundaries."""

    def __init__(self, patterns: list[str], bounded: list[bool]) -> None:
        self.lengths = np.array([len(p.encode()) for p in patterns], np.int64)
        self.bounded = np.array(bounded, bool)
        points = word_points()
        self.first, self.last = (np.array([bool(p) and bool(points[ord(p[k])]) for p in patterns], bool) for k in (0, -1))
        self.count, self.automata, group, size = len(patterns), [], [], 0
        width = 4 * (len({b for p in patterns for b in p.encode()}) + 1)
        # A text may stand for two patterns, bounded and not: the automaton knows it once.
        same: dict[bytes, list[int]] = {}
        for n, p in enumerate(patterns):
            if p:
                same.setdefault(p.encode(), []).append(n)
        numbers = sorted(same)
        self.numbers = np.array([n for p in numbers for n in same[p]], np.int64)
        self.starts = np.cumsum([0, *(len(same[p]) for p in numbers)])
        for number, pattern in enumerate(numbers):
            size += len(pattern)
            if group and size * width > TABLE:
                self.automata.append(Automaton.of(group))
                group, size = [], len(pattern)
            group.append((number, pattern))
        if group:
            self.automata.append(Automaton.of(group))

    @staticmethod
    def _word_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the code point whose first byte is at each place is part of words."""
        byte = lambda k: data[np.minimum(at + k, len(data) - 1)].astype(np.int64)
        b, low = byte(0), [byte(k) & 0x3F for k in (1, 2, 3)]
        point = np.select([b < 0x80, b < 0xE0, b < 0xF0], [b, (b & 0x1F) << 6 | low[0], (b & 0x0F) << 12 | low[0] << 6 | low[1]], (b & 0x07) << 18 | low[0] << 12 | low[1] << 6 | low[2])
        return word_points()[np.minimum(point, 0x10FFFF)]

    def found(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of a text and a pattern that it holds, by text and pattern. Empty patterns are in none."""
        pairs = [np.zeros(0, np.int64)]
        for automaton in self.automata if len(data) else ():
            for ends, which in automaton.ends(data, offsets):
                size = self.starts[which + 1] - self.starts[which]
                numbers = self.numbers[np.repeat(self.starts[which] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                ends = np.repeat(ends, size)
                text = np.searchsorted(offsets, ends, side="left") - 1
                begin = ends - self.lengths[numbers]
                ok = ~self.bounded[numbers]
                look = np.flatnonzero(~ok)
                if len(look):
                    before, after = begin[look], ends[look]
                    back = before - 1
                    for _ in range(3):
                        back = np.where((back > 0) & ((data[np.maximum(back, 0)] & 0xC0) == 0x80), back - 1, back)
                    left = (before > offsets[text[look]]) & self._word_at(data, np.maximum(back, 0))
                    right = (after < offsets[text[look] + 1]) & self._word_at(data, after)
                    ok[look] = (left != self.first[numbers[look]]) & (right != self.last[numbers[look]])
                pairs.append(np.unique(text[ok] * self.count + numbers[ok]))
        whole = np.unique(np.concatenate(pairs))
        return whole // max(self.count, 1), whole % max(self.count, 1)


def laid_out(texts: pa.Array, limit: int = LAID_OUT) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in groups of about `limit` bytes: the number of the first, their bytes and offsets. Null is empty; a longer text is a group by itself."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high
