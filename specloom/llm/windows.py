"""Anchored windows of symbol sequences: what the two repeat removers share.

Every window of ``length`` symbols has one anchor: of the ``gram``-symbol strings in it the one of smallest hash, the
first of equals. The choice depends on the window's contents alone, so equal windows have equal anchors at equal
offsets, and a window whose anchor string occurs once in the corpus occurs once itself. Neighbouring windows mostly
share an anchor, so there are about 2 / (length - gram + 2) anchors per symbol, each with a contiguous range of windows.
"""

from __future__ import annotations

import numpy as np

from specloom.llm.common import Powers, mix, prefix_sums, span_hash, symbol_table

#: Symbols handled at once; offsets within a block take 24 bits.
BLOCK = 1 << 19
_POWERS = Powers()
_BYTES = symbol_table(3)
_LOW = np.uint64((1 << 24) - 1)
_HIGH = ~_LOW


def blocks(sequences: list[np.ndarray], length: int):
    """Group sequences into blocks of about BLOCK symbols: lists of (sequence, first symbol, last symbol).

    A longer sequence is cut into parts that overlap by ``length`` - 1 symbols, so each window lies in one part.
    """
    out, size = [], 0
    for i, x in enumerate(sequences):
        n = len(x)
        if n < length:
            continue
        for s in range(0, n - length + 1, BLOCK):
            e = min(n, s + BLOCK + length - 1)
            out.append((i, s, e))
            size += e - s
            if size >= BLOCK:
                yield out
                out, size = [], 0
    if out:
        yield out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values, by doubling."""
    n, have, m = len(x) - w + 1, 1, x
    while 2 * have <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[:n], m[w - have : w - have + n]) if have < w else m[:n]


class Anchors:
    """Anchors of a block: arrays with an entry each.

    seq: the sequence; at: the anchor's offset in the block; lo, hi: offsets of its first and last window;
    key: hash of the anchor string; base: what to subtract from offsets to get those in the sequence.
    """

    def __init__(self, sequences: list[np.ndarray], block: list[tuple[int, int, int]], length: int, gram: int):
        values = np.concatenate([sequences[i][s:e] for i, s, e in block]) if len(block) > 1 else sequences[block[0][0]][block[0][1] : block[0][2]]
        if values.dtype == np.uint8:
            values = _BYTES[values]
        self.length, self.gram = length, gram
        self.sums, self.down = prefix_sums(values, _POWERS)
        n = len(values)
        sizes = np.array([e - s for _, s, e in block])
        ends = np.cumsum(sizes)
        # the order of grams: any fixed function of their contents, with the offset below it
        raw = (self.sums[gram:] - self.sums[:-gram]) * self.down[: n - gram + 1]
        raw ^= raw >> np.uint64(29)
        raw *= np.uint64(0xBF58476D1CE4E5B9)
        order = (raw & _HIGH) | np.arange(n - gram + 1, dtype=np.uint64)
        at = (sliding_min(order, length - gram + 1) & _LOW).astype(np.int32)
        start = np.concatenate([[0], ends[:-1]])
        valid = np.ones(n - length + 1, bool)
        for e in ends[:-1].tolist():
            valid[max(0, e - length + 1) : e] = False
        new = np.empty(len(valid), bool)
        new[0] = True
        np.not_equal(at[1:], at[:-1], out=new[1:])
        new[1:] |= ~valid[:-1]
        new &= valid
        self.lo = np.flatnonzero(new)
        last = np.empty(len(valid), bool)
        last[-1] = True
        np.logical_or(new[1:], ~valid[1:], out=last[:-1])
        self.hi = np.flatnonzero(last & valid)
        self.at = at[self.lo].astype(np.int64)
        part = np.searchsorted(ends, self.lo, "right")
        self.seq = np.array([i for i, _, _ in block])[part]
        self.base = start[part] - np.array([s for _, s, _ in block])[part]
        self.part = part
        self.end = ends[part]
        self.key = span_hash(self.sums, self.down, self.at, self.at + gram)

    def extent(self, pick: np.ndarray) -> np.ndarray:
        """Hash of all symbols in the windows of each picked anchor, and of where the anchor stands in them."""
        return mix(span_hash(self.sums, self.down, self.lo[pick], self.hi[pick] + self.length) + (self.at[pick] - self.lo[pick]).astype(np.uint64))

    def window_hashes(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of the picked anchors one after another, and how many each has."""
        count = self.hi[pick] - self.lo[pick] + 1
        first = np.cumsum(count) - count
        i = np.arange(int(count.sum())) - np.repeat(first - self.lo[pick], count)
        return span_hash(self.sums, self.down, i, i + self.length), count


def filter_words(bits: int) -> int:
    return 1 << max(0, bits - 6)


class KeyFilter:
    """A bitmap of hashed keys of fixed size: tells keys that are certainly not in a set."""

    def __init__(self, bits: int, words: np.ndarray):
        self.shift, self.words = np.uint64(64 - bits), words

    def holds(self, keys: np.ndarray) -> np.ndarray:
        b = keys >> self.shift
        return (self.words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) > 0
