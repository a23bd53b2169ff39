"""Quality rules: document statistics, two fixed rules on them, and gradient-boosted trees for the rest.

Every text is reduced to counts (``STATISTICS``), the counts to ratios (``FEATURES``). Trees are boosted on the ratios of
a bounded sample of labelled rows, with histograms of each ratio's values; ratios marked -1 in ``SIGNS`` may only lower a
score as they grow: a split against its sign is refused, and what stands below a split keeps to its side of the middle
of the two values. The trees are flattened into arrays of nodes that score all rows of a batch at once, level by level.

Defined results: null text is an empty one and fails the rules, as any text of less than MIN_WORDS words does. Repeated
rows each give their row; null ids stay. Labels of null id or quality teach nothing, ids with several labels teach each of
them. Without labels, or with labels of one class only, there are no trees and the fixed rules decide. Lines are equal if
all their characters are; windows of words are compared exactly. Documents are independent: scoring shuffles nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import BLANK, WORD_PATTERN, documents, pieces, to_bytes, trim, with_columns_of

#: Labelled rows that the trees are fitted on, those of smallest hash.
SAMPLE = 20_000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # percent
SYMBOLS = "#*$%&|<>"

#: Counts of a text; the first five are returned.
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_most_frequent", "n_capital", "n_small", "n_digits", "n_marks", "n_stops")
FEATURES = ("log_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "most_frequent_share", "capital_share", "digits_per_word", "marks_per_word", "stops_per_word", "words_per_line")
#: -1: a greater value never makes a document better.
SIGNS = (0, 0, -1, -1, -1, 0, -1, -1, 0, -1, 0, 0)

_WORDS = re.compile(WORD_PATTERN)
_BLANKS = " \t\n\v\f\r"
_CLASSES = {"n_capital": range(65, 91), "n_small": range(97, 123), "n_digits": range(48, 58), "n_marks": b"!\"#$%&()*+/:;<=>@[]^_`{|}~", "n_stops": b".?"}


def repeated_words(words: list[str], size: int = WINDOW) -> int:
    """Words in windows of ``size`` (a power of two) consecutive words that the text holds twice or more, the first included.

    Windows get numbers by doubling: two windows are equal if their halves' numbers are."""
    n = len(words)
    if n <= size:
        return 0
    number: dict[str, int] = {}
    rank = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == n:
        return 0
    have = 1
    while have < size:
        pairs = rank[:-have] * np.int64(n + 1) + rank[have:]
        kinds, rank = np.unique(pairs, return_inverse=True)
        if len(kinds) == len(pairs):
            return 0  # longer windows differ as well
        have *= 2
    again = np.flatnonzero(np.bincount(rank)[rank] > 1)
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + size, -1)
    return int(np.count_nonzero(np.cumsum(covered)))


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts of STATISTICS; those of letters, digits and marks are of ASCII."""
    text = text or ""
    words = _WORDS.findall(text)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(_BLANKS):
            lines += 1
            dup += line in seen
            seen.add(line)
    counts = Counter(words)
    octets = np.bincount(np.frombuffer(to_bytes(text), np.uint8), minlength=256)
    kinds = {k: int(octets[np.frombuffer(bytes(v), np.uint8)].sum()) for k, v in _CLASSES.items()}
    symbols = int(octets[np.frombuffer(SYMBOLS.encode(), np.uint8)].sum())
    chars = sum(map(len, words))
    return (len(words), chars, symbols, dup, repeated_words(words), lines, len(counts), max(counts.values(), default=0), *kinds.values())


def features(stats: np.ndarray) -> np.ndarray:
    """Ratios (a column for each of FEATURES) of rows of STATISTICS."""
    c = dict(zip(STATISTICS, stats.reshape(-1, len(STATISTICS)).astype(np.float64).T, strict=True))
    n, lines, letters = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1), np.maximum(c["n_capital"] + c["n_small"], 1)
    columns = (np.log1p(c["n_words"]), c["word_chars"] / n, c["n_symbols"] / n, c["n_dup_lines"] / lines, c["n_repeat_words"] / n, c["n_distinct_words"] / n, c["n_most_frequent"] / n, c["n_capital"] / letters, c["n_digits"] / n, c["n_marks"] / n, c["n_stops"] / n, c["n_words"] / lines)
    return np.stack(columns, 1)


@dataclass
class Forest:
    """Boosted trees as node arrays. A leaf is its own child; rows go left if their feature is at most the threshold."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row of ``x``: all rows walk all trees a level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)


def fit(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...] = SIGNS, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Forest:
    """Trees for the log odds of ``y`` (0 or 1), each on the gradients that those before it leave."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(x) else []
    code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1) if len(x) else None
    margin = np.full(len(y), base)

    def weight(g, h, lo, hi):
        return np.clip(-g / (h + ridge), lo, hi)

    def worth(g, h, w):
        return -(g * w + 0.5 * (h + ridge) * w * w)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, lo: float, hi: float, levels: int) -> int:
        me = len(nodes)
        total = g[rows].sum(), h[rows].sum()
        w = float(weight(*total, lo, hi))
        nodes.append([0, 0.0, me, me, rate * w])
        best = (1e-6, -1, -1, 0.0, 0.0)
        for f in range(x.shape[1]) if levels else ():
            c, n = code[rows, f], len(edges[f])
            if not n:
                continue
            gl, hl, nl = (np.cumsum(np.bincount(c, v, minlength=n + 1))[:n] for v in (g[rows], h[rows], None))
            gr, hr = total[0] - gl, total[1] - hl
            wl, wr = weight(gl, hl, lo, hi), weight(gr, hr, lo, hi)
            gain = worth(gl, hl, wl) + worth(gr, hr, wr) - worth(*total, w)
            fits = (nl >= least) & (len(rows) - nl >= least) & (signs[f] * (wr - wl) >= 0)
            gain = np.where(fits, gain, -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k, float(wl[k]), float(wr[k]))
        _, f, k, wl, wr = best
        if f < 0:
            margin[rows] += rate * w
            return me
        goes = code[rows, f] <= k
        middle = (wl + wr) / 2
        below, above = ((lo, middle), (middle, hi)) if signs[f] > 0 else ((middle, hi), (lo, middle)) if signs[f] < 0 else ((lo, hi), (lo, hi))
        a = grow(rows[goes], g, h, *below, levels - 1)
        b = grow(rows[~goes], g, h, *above, levels - 1)
        nodes[me] = [f, float(edges[f][k]), a, b, 0.0]
        return me

    if 0 < y.sum() < len(y):
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, depth))
    a = np.array(nodes, np.float64).reshape(-1, 5)
    whole = lambda k: a[:, k].astype(np.int32)
    return Forest(base, np.array(roots, np.int32), whole(0), a[:, 1], whole(2), whole(3), a[:, 4], depth)


def text_statistics(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """doc_id, the columns of STATISTICS, and the trees' log odds (null without trees) for every row."""
    d = with_columns_of(docs, "doc_id", "text")
    frozen = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in pieces(batches):
            stats = np.array([statistics(x.as_py()) for x in b.column(1)], np.int64).reshape(-1, len(STATISTICS))
            f = frozen.value
            score = pa.nulls(len(stats), pa.float64()) if f is None or not len(f.roots) else pa.array(f.score(features(stats)))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, stats.T), score], names=["doc_id", *STATISTICS, "score"])
        trim()

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in STATISTICS)}, score double")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Trees fitted on at most ``sample`` labelled rows, those whose id and text hash smallest.

    At most ``sample`` ids are broadcast, and as many rows of counts reach the driver."""
    own = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("id"), (F.col("quality") > 0).cast("double").alias("y")).distinct()
    own = own.withColumn("rank", F.xxhash64("id", "y")).orderBy("rank", "id").limit(sample)
    rows = with_columns_of(docs, "doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("id"))
    # the label travels with the id, so that statistics are taken where the texts are
    rows = rows.select(F.struct("id", "y", F.xxhash64("id", "text").alias("hash")).alias("doc_id"), "text")
    t = text_statistics(rows).orderBy("doc_id.hash", "doc_id.y").limit(sample).select("doc_id.y", *STATISTICS).toArrow()
    stats = np.stack([t.column(c).to_numpy() for c in STATISTICS], 1)
    y = t.column("y").to_numpy()
    order = np.lexsort((*stats.T, y))
    return fit(features(stats[order]), y[order])


def judged(stats: DataFrame) -> DataFrame:
    """Statistics with base_failed, of the fixed rules, and kept: false if these fail, else whether the trees' odds are even or better."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return stats.withColumns({"base_failed": failed, "kept": ~failed & (F.coalesce("score", F.lit(0.0)) >= 0)})


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    forest = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(text_statistics(docs, forest)).select("doc_id", *STATISTICS[:5], "base_failed", "kept")
