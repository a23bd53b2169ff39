"""Periodic runs of words: stretches that repeat a phrase back to back.

A run is a stretch of words with smallest period q (words q apart are identical) and a length of at least
max(MIN_LENGTH, REPEATS * q) that no neighbouring word extends. Blocks of B = 8, 16, 32 ... words at multiples of B are
the keys of an integer-sequence automaton, which is run over the whole document. A block that occurs again at a distance
of that scale (B to 2B - 1; 1 to 15 for the smallest) seeds a stretch of that period, which is extended word by word both ways.

No run is missed: one of period q in [B, 2B) leaves q-shifted room for length - q >= 2q >= 2B - 1 words, in which some
aligned block of B words lies whole, and its copy at distance q is in the run too (for q < 8: at least 24 - 7 = 17 words).
Equality is that of the words themselves, so results are exact. Documents are independent; there is no shuffle.

Null text has no words and no runs; null ids stay, and repeated rows each give their own row. Long documents are searched
in windows of WINDOW words, or four blocks where blocks are larger, so that an automaton follows the scale. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import WORD_PATTERN, documents, pieces, trim, with_columns_of

MIN_LENGTH = 24
REPEATS = 3
SMALLEST = 8
#: Words that one automaton covers, a power of two; blocks of up to a sixteenth of it share one automaton.
WINDOW = 1 << 15
#: Characters of collapsed texts in a batch of results.
BATCH = 1 << 24

_WORDS = re.compile(WORD_PATTERN)

Run = tuple[int, int, int]  # start, length, period


class Stretches:
    """Maximal stretches found so far, by period."""

    def __init__(self, ids: tuple[int, ...]):
        self.ids, self.by = ids, {}

    def known(self, a: int, d: int, end: int) -> bool:
        """Whether a stretch whose period divides ``d`` covers [a, end): then nothing new has period d there."""
        for q, (starts, ends) in self.by.items():
            if d % q == 0 and (k := bisect_right(starts, a)) and ends[k - 1] >= end:
                return True
        return False

    def extend(self, a: int, d: int, end: int) -> None:
        """Add the maximal stretch of period ``d`` around [a, end)."""
        x, n, step = self.ids, len(self.ids), 256
        while end + step <= n and x[end : end + step] == x[end - d : end - d + step]:
            end += step
        while end < n and x[end] == x[end - d]:
            end += 1
        while a >= step and x[a - step : a] == x[a - step + d : a + d]:
            a -= step
        while a and x[a - 1] == x[a - 1 + d]:
            a -= 1
        starts, ends = self.by.setdefault(d, ([], []))
        k = bisect_right(starts, a)
        starts.insert(k, a)
        ends.insert(k, end)

    def runs(self) -> list[Run]:
        out = [(s, e - s, d) for d, (starts, ends) in self.by.items() for s, e in zip(starts, ends, strict=True) if e - s >= max(MIN_LENGTH, REPEATS * d)]
        return sorted((r for r in out if self._smallest(*r)), key=lambda r: (r[0], r[2]))

    def _smallest(self, s: int, length: int, d: int) -> bool:
        """A smaller period of a stretch of two periods or more divides ``d``, so a prime factor of d tells."""
        x, e = self.ids, s + length
        return not any(x[s : e - d // r] == x[s + d // r : e] for r in _primes(d))


def _primes(n: int) -> list[int]:
    out, r = [], 2
    while r * r <= n:
        if n % r == 0:
            out.append(r)
            while n % r == 0:
                n //= r
        r += 1
    return out + [n] * (n > 1)


def _scales(n: int) -> list[list[int]]:
    """Block sizes whose smallest period can have a run in ``n`` words, grouped by automaton."""
    if n < max(MIN_LENGTH, REPEATS):
        return []
    small, large, b = [SMALLEST], [], 2 * SMALLEST
    while REPEATS * b <= n:
        (small if b <= WINDOW // 16 else large).append(b)
        b *= 2
    return [small, *([b] for b in large)]


def _seeds(part: tuple[int, ...], step: int, sizes: list[int]):
    """(a, d, block): aligned blocks of the first ``step`` words of ``part`` that occur again ``d`` words further on."""
    trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    first: dict[tuple[int, ...], int] = {}
    same = {}
    for b in sizes:
        mine = same[b] = []
        for a in range(0, min(step, len(part) - b + 1), b):
            key = part[a : a + b]
            lead = first.setdefault(key, a)
            if lead == a:
                trie.add_word(key, (b, a))
            mine.append(lead)
    del first
    if not len(trie):
        return
    trie.make_automaton()
    for last, (b, lead) in trie.iter(part):
        p = last - b + 1
        k = (p - (b if b > SMALLEST else 1)) // b
        mine = same[b]
        if 0 <= k < len(mine) and mine[k] == lead:
            yield k * b, p - k * b, b
        if b == SMALLEST and 0 < k <= len(mine) and p - (k - 1) * b < 2 * b and mine[k - 1] == lead:
            yield (k - 1) * b, p - (k - 1) * b, b


def find_runs(words: list) -> list[Run]:
    """start, length and smallest period of every run, by start and period. ``words`` may be any hashable values."""
    number: dict = {}
    ids = tuple([number.setdefault(w, len(number)) for w in words])
    del number
    found = Stretches(ids)
    for sizes in _scales(len(ids)):
        top = sizes[-1]
        step = max(WINDOW, 4 * top)
        for at in range(0, len(ids), step):
            for a, d, b in _seeds(ids[at : at + step + 3 * top], step, sizes):
                a += at
                if not found.known(a, d, a + d + b):
                    found.extend(a, d, a + d + b)
    return found.runs()


def collapse(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that a run holds after its first period."""
    drop = bytearray(len(words))
    for s, length, q in runs:
        drop[s + q : s + length] = b"\1" * (length - q)
    return [w for w, gone in zip(words, drop, strict=True) if not gone]


def periodic_runs(docs: DataFrame, prepare: Callable[[int | None, list[str]], list[str]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of every row.

    ``prepare`` may replace a document's words before they are searched."""
    d = with_columns_of(docs, "doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in pieces(batches, 256):
            ids, n, found, texts, size = [], [], [], [], 0

            def batch():
                return pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(n, pa.int64()), pa.array(found, runs_type), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])  # noqa: B023

            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = _WORDS.findall(text.as_py() or "")
                words = prepare(i, words) if prepare else words
                runs = find_runs(words)
                ids.append(i)
                n.append(len(words))
                found.append([{"start": s, "length": length, "period": q} for s, length, q in runs])
                texts.append(" ".join(collapse(words, runs)))
                size += len(texts[-1])
                if size >= BATCH:
                    yield batch()
                    ids, n, found, texts, size = [], [], [], [], 0
            if ids:
                yield batch()
        trim()

    return d.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared by whole numbers; of equals the first by start, then period; null if none."""

    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.reduce(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The contract's periodic tail: one document in ten repeats a phrase from some word on. A null id has none."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    phrase = words[a : a + p]
    return words[:a] + [phrase[i % p] for i in range(n - a)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(documents(spark, sf_dir), planted).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    length, period = F.col("best.length"), F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
