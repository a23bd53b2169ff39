"""Removal of word sequences that repeat anywhere, by suffixes partitioned by prefix.

Of suffix trees only the nodes of depth WINDOW matter here, so none is built: equal windows, told by hash, stand for such
a node, and prefixes have two lengths (GRAM words, or the whole window). Each window of WINDOW words has an anchor, a string
of ``GRAM`` words that its contents choose; a first pass counts anchors, and windows whose anchor occurs once are
dropped. The suffixes that remain are partitioned by the anchor as a prefix and, below an anchor that occurs more than
``HOT`` times, by the whole window as a longer one, so each partition is of a size that memory holds whatever repeats.
In a partition, sorted windows that are equal would share an internal node of depth WINDOW; runs of such windows are the
maximal repeats, and the words they cover are removed.

Windows are told apart by 64-bit hashes of their words. Null texts have no words; texts shorter than a window keep all.
A removed word stays removed whatever else is; windows are judged on the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from specloom.llm.common import discard, documents, materialize, release, words_of
from specloom.llm.repeats import HOT, WINDOW_ROWS, anchor_counts, chunks, cut_texts, gather_spans, key_filter, opened, picked, repeated_windows, window_rows, with_own_keys
from specloom.llm.windows import Anchors, blocks

WINDOW = 35
GRAM = 8


def _words(data: bytes) -> np.ndarray:
    return words_of(data)[2]


def repeated_words(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id, tag, spans of the words covered by repeated windows."""
    counts = materialize(spark, anchor_counts(docs, _words, window, gram), "anchors")
    keys, hot = key_filter(spark, counts), key_filter(spark, counts.where(f"n > {HOT}"))
    release(spark)

    def run(batches):
        wanted, common = opened(keys), opened(hot)
        for ids, tags, seqs, own in chunks(batches, _words):
            for b in blocks(seqs, window):
                a = Anchors(seqs, b, window, gram)
                pick = picked(a, wanted, own)
                if len(pick):
                    yield window_rows(a, pick, ids, tags, common.holds(a.key[pick]))

    spans = repeated_windows(spark, with_own_keys(docs, _words, window, gram, counts).mapInArrow(run, WINDOW_ROWS), window)
    discard(spark, counts)
    return gather_spans(spans)


def _cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    start, end, _ = words_of(data)
    kept = np.ones(len(start), bool)
    for s, e in spans:
        kept[s:e] = False
    words = [data[i:j] for i, j in zip(start[kept].tolist(), end[kept].tolist(), strict=True)]
    return len(start), len(start) - len(words), hashlib.sha256(b" ".join(words)).hexdigest()


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return cut_texts(docs, repeated_words(spark, docs), _cut, "n_words bigint, n_removed bigint, kept_sha256 string", ["n_words", "n_removed", "kept_sha256"])
