"""Benchmark decontamination by spaced-seed hashing.

Texts are words (lower-cased runs of letters and digits of any script). Each fixed mask spans some words and looks
at part of them, so a hash under it survives substitutions at the positions it ignores. Hashes of the benchmark items
under all masks form the index, sorted and split in blocks of bounded size; every document's hashes under the same
masks are looked up in each block. A hit fixes an alignment of document and item, along which the longest stretch is
verified: it must hold at least ``MIN_WORDS`` words, of which ``PERCENT`` in a hundred agree, beginning and ending with
words that agree; or the whole item must agree by that share, wherever the differences stand.

The masks miss no such stretch: m differences leave m + 1 runs of at least 4 m words together, so one run has four
words, save for AAAxAAAxAAAxAAA, which has a mask of its own, and whole items of 10 or 11 words with two differences,
for which runs of three are looked up.

Items with fewer words than ``SHORTEST`` are found word for word, by the hash of all their words. Null and empty texts,
and items without a word, have no overlap. Repeated items count once; of equal stretches the first in the document is given.
Only the benchmark is broadcast, in blocks of at most ``BLOCK_WORDS`` words; each block is one pass over the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from specloom.llm.common import Powers, documents, mix, prefix_sums, span_hash, symbol_table, with_columns_of

#: Spaced seeds: a 1 is a position that is compared, and the most words of items that it is for.
MASKS = (("1111", None), ("111011101110111", None), ("111", 11))
#: Words that are compared along alignments at once.
AT_ONCE = 1_000_000
MIN_WORDS = 13
SHORTEST = 8
PERCENT = 80
BLOCK_WORDS = 1_000_000

_TABLE = symbol_table(17)
_POWERS = Powers(0xA0761D6478BD642F)
_STEPS = [np.uint64(int(x) | 1) for x in np.random.default_rng(23).integers(1 << 62, 1 << 63, 32, dtype=np.uint64)]
_LETTERS = regex.compile(r"[^\p{L}\p{N}]+")


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text."""
    if not text:
        return np.zeros(0, np.uint64)
    text = text.lower()
    data = text.encode("utf-8", "replace")
    a = np.frombuffer(data, np.uint8)
    # ASCII is decided by table; other characters count as letters unless a rare check finds some that are not
    inside = _IN_WORD[a]
    if not text.isascii() and _ODD.search(text):
        data = _LETTERS.sub(" ", text).encode("utf-8", "replace")
        a = np.frombuffer(data, np.uint8)
        inside = _IN_WORD[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    s, down = prefix_sums(_TABLE[a], _POWERS)
    return span_hash(s, down, edge[::2], edge[1::2])


_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_ODD = regex.compile(r"[^\p{L}\p{N}\x00-\x7F]")


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash under ``mask`` at each position where it fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            x += h[k : k + n] * _STEPS[k]
    return mix(x + np.uint64(len(mask) * 131 + mask.count("1")))


class Index:
    """Seed hashes of a block of items, sorted, with the item and position of each."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        self.sizes = np.array([len(h) for _, h in items], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = np.concatenate([np.zeros(0, np.uint64), *(h for _, h in items)])
        self.least = np.array([needed(n) for n in self.sizes.tolist()], np.int64)
        self.tables = []
        for mask, longest in MASKS:
            hs, who, where = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, (_, h) in enumerate(items):
                if len(h) < SHORTEST or longest is not None and len(h) > longest:
                    continue
                s = seeds(h, mask)
                hs.append(s)
                who.append(np.full(len(s), k))
                where.append(np.arange(len(s)))
            h, w, p = np.concatenate(hs), np.concatenate(who), np.concatenate(where)
            if not len(h):
                continue
            o = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 21, bool)
            bits[(h >> np.uint64(43)).astype(np.int64)] = True
            self.tables.append((mask, h[o], w[o], p[o], bits))
        #: for each length of short items the hashes of all their words, sorted, and the items
        self.short: list[tuple[str, np.ndarray, np.ndarray]] = []
        for n in sorted({len(h) for _, h in items if len(h) < SHORTEST}):
            who = np.array([k for k, (_, h) in enumerate(items) if len(h) == n], np.int64)
            hs = np.array([seeds(items[k][1], "1" * n)[0] for k in who.tolist()], np.uint64)
            o = np.argsort(hs, kind="stable")
            self.short.append(("1" * n, hs[o], who[o]))

    def hits(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(item, document position minus item position) of all seeds in common, if the words along them can suffice."""
        found: set[tuple[int, int]] = set()
        for mask, hs, who, where, bits in self.tables:
            s = seeds(h, mask)
            at = np.flatnonzero(bits[(s >> np.uint64(43)).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(hs, s[at], "left"), np.searchsorted(hs, s[at], "right")
            some = hi > lo
            at, lo, n = at[some], lo[some], (hi - lo)[some]
            # in parts of bounded size, as a phrase may stand in many items and many times in a document
            part = np.cumsum(n) // AT_ONCE
            for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
                i = np.repeat(lo[cut] - np.cumsum(n[cut]) + n[cut], n[cut]) + np.arange(int(n[cut].sum()))
                pairs = np.unique(np.stack([who[i], np.repeat(at[cut], n[cut]) - where[i]]), axis=1) if len(i) else np.zeros((2, 0), np.int64)
                found.update(self._enough(h, *pairs))
        return sorted(found)

    def _enough(self, h: np.ndarray, item: np.ndarray, shift: np.ndarray):
        """The alignments on which as many words agree as any stretch needs."""
        a = np.maximum(0, -shift)
        n = np.minimum(self.sizes[item], len(h) - shift) - a
        fits = n >= self.least[item]
        item, shift, a, n = item[fits], shift[fits], a[fits], n[fits]
        part = np.cumsum(n) // AT_ONCE
        for cut in np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1):
            if not len(cut):
                continue
            begin = np.cumsum(n[cut]) - n[cut]
            at = np.arange(int(n[cut].sum())) + np.repeat(a[cut] - begin, n[cut])
            same = self.words[at + np.repeat(self.starts[item[cut]], n[cut])] == h[at + np.repeat(shift[cut], n[cut])]
            good = cut[np.add.reduceat(same, begin, dtype=np.int64) >= self.least[item[cut]]]
            yield from zip(item[good].tolist(), shift[good].tolist(), strict=True)

    def _whole(self, h: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """The short items that stand in a document word for word: words, minus the first place, words."""
        best: dict[int, tuple[int, int, int]] = {}
        for mask, hs, who in self.short:
            n = len(mask)
            kinds, first = np.unique(seeds(h, mask), return_index=True)
            lo, hi = np.searchsorted(hs, kinds, "left"), np.searchsorted(hs, kinds, "right")
            for x in np.flatnonzero(hi > lo).tolist():
                at = int(first[x])
                for k in who[lo[x] : hi[x]].tolist():
                    if np.array_equal(h[at : at + n], self.items[k][1]):
                        best[k] = (n, -at, n)
        return best

    def overlaps(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, first word in the document, words, words that agree) of every item found, its best stretch."""
        h = word_hashes(text)
        best = self._whole(h)
        for k, shift in self.hits(h) if len(h) >= SHORTEST else ():
            item = self.items[k][1]
            a, b = max(0, -shift), min(len(item), len(h) - shift)
            found = stretch(h[a + shift : b + shift] == item[a:b], len(item))
            if found is None:
                continue
            s, e, agree = found
            new = (agree, -(a + s + shift), e - s)
            if new > best.get(k, (0, -len(h) - 1, 0)):
                best[k] = new
        return [(self.items[k][0], -at, n, agree) for k, (agree, at, n) in sorted(best.items())]


def needed(size: int) -> int:
    """The least number of words that agree in a stretch of an item of ``size`` words."""
    return -(-PERCENT * min(MIN_WORDS, size) // 100)


def stretch(same: np.ndarray, size: int) -> tuple[int, int, int] | None:
    """The longest similar part of an alignment with an item of ``size`` words, the first of equals: the whole item,
    or ``MIN_WORDS`` words or more that begin and end with words that agree."""
    agree = int(same.sum())
    if len(same) == size and 100 * agree >= PERCENT * size:
        return 0, size, agree
    at = np.flatnonzero(same)
    if not len(at):
        return None
    # agreements weigh as the share of differences allowed and differences as the share of agreements asked for, so
    # what does not score below nothing is similar enough; for each end the first start from which it does not
    total = np.concatenate([[0], np.cumsum(np.where(same, 100 - PERCENT, -PERCENT))])
    first = np.searchsorted(-np.minimum.accumulate(total[at]), -total[at + 1], "left")
    length = at + 1 - at[first]
    k = int(np.argmax(length))
    if length[k] < MIN_WORDS:
        return None
    s, e = int(at[first[k]]), int(at[k]) + 1
    return s, e, int(same[s:e].sum())


def item_blocks(benchmark: DataFrame, words: int = BLOCK_WORDS):
    """Lists of (item id, word hashes), read row by row, each of at most ``words`` words plus one item."""
    block, size = [], 0
    for r in with_columns_of(benchmark, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        h = word_hashes(r["text"])
        if not len(h):
            continue
        block.append((r["item_id"], h))
        size += len(h)
        if size >= words:
            yield block
            block, size = [], 0
    if block:
        yield block


OVERLAPS = "item_id bigint, doc_start bigint, n_words bigint, n_agree bigint"


def overlaps(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_start, n_words, n_agree: every document and item that overlap."""
    source = with_columns_of(docs, "doc_id", "text")
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {OVERLAPS}"
    out = None
    for block in item_blocks(benchmark):
        frozen = spark.sparkContext.broadcast(block)

        def run(batches, frozen=frozen):
            index = Index(frozen.value)
            for b in batches:
                ids, rows = [], []
                for i, x in zip(b.column(0), b.column(1), strict=True):
                    for r in index.overlaps(x.as_py()):
                        ids.append(i.as_py())
                        rows.append(r)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), *(pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True))], names=["doc_id", "item_id", "doc_start", "n_words", "n_agree"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that overlap no item."""
    at = docs.columns.index("text")
    for block in item_blocks(benchmark):
        frozen = spark.sparkContext.broadcast(block)

        def run(batches, frozen=frozen):
            index = Index(frozen.value)
            for b in batches:
                yield b.filter(pa.array([not index.overlaps(x.as_py()) for x in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: one row per document and benchmark item that overlap."""
    return overlaps(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
