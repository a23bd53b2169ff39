"""Removal of byte strings that repeat anywhere, by doubled string lengths at sampled positions.

Sorting a suffix per byte is not affordable (figures in the README), so what is built departs from prefix doubling in two
ways: positions are sampled, and a string's rank is a hash of its bytes, found where the text is, not a place in a sorted
list of rank pairs; Spark counts equal hashes by shuffles and tells which are shared. Each ``WINDOW``-byte string has an
anchor, the position in it of a ``GRAM``-byte string that its contents choose, so equal strings have equal anchors.

1. Rank 0 of an anchor is its GRAM-byte string. Anchors of unique rank drop out.
2. Doubling: hashes of 128 and of WINDOW bytes, of anchors whose shorter string is still shared, are counted until they
   are unique or past the threshold. They serve as a filter: a string that became unique rules out all windows that hold it.
3. An anchor's extent, from its first window to the end of its last, is ranked past the threshold at once: if it is
   shared, all of it is removed. Only where anchors of one rank 0 have different extents, at the ends of repeats, are
   the remaining windows themselves ranked and compared.

Strings are told apart by 64-bit hashes. Null text is empty; texts shorter than WINDOW keep all. Matches never cross
documents; a string that repeats in one document, overlapping itself or not, is removed too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import as_long, discard, documents, materialize, mix, release, span_hash
from specloom.llm.repeats import HOT, WINDOW_ROWS, anchor_counts, chunks, cut_texts, gather_spans, key_filter, merge, named, opened, picked, repeated_windows, row_id, row_tag, window_rows, with_own_keys
from specloom.llm.windows import Anchors, blocks

WINDOW = 200
GRAM = 64
#: Extents a task remembers as compared; it forgets them beyond, so that one may be compared again.
SEEN = 1_000_000
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def _symbols(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def doubled(a: Anchors, pick: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Ranks of the picked anchors at growing lengths: each from the pair of the rank before and that of the bytes
    that follow it. A rank that runs over the end of its document is unique by the offset of that end."""
    at, end = a.at[pick], a.end[pick]
    ranks, lengths, have, rank = [], [], a.gram, a.key[pick]
    while have < a.length:
        reach = min(2 * have, a.length)
        stop = np.minimum(at + reach, end)
        rank = mix(rank * _PAIR + span_hash(a.sums, a.down, np.minimum(at + have, end), stop) + (at + reach - stop).astype(np.uint64))
        ranks.append(rank)
        lengths.append(reach)
        have = reach
    return ranks, lengths


def repeated_bytes(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id, tag, spans of the bytes covered by repeated windows."""
    counts = materialize(spark, anchor_counts(docs, _symbols, window, gram), "anchors")
    keys, hot = key_filter(spark, counts), key_filter(spark, counts.where(f"n > {HOT}"))
    release(spark)

    def survivors(batches):
        wanted = opened(keys)
        for ids, tags, seqs, _ in chunks(batches, _symbols):
            for b in blocks(seqs, window):
                a = Anchors(seqs, b, window, gram)
                pick = picked(a, wanted, None)
                if len(pick):
                    ranks, _ = doubled(a, pick)
                    own, off = a.seq[pick], a.base[pick]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[own]), pa.array(tags[own]), pa.array((a.lo[pick] - off).astype(np.int64)), pa.array((a.hi[pick] - off + window).astype(np.int64)),
                        pa.array(as_long(a.key[pick])), pa.array(as_long(a.extent(pick))), pa.ListArray.from_arrays(np.arange(len(pick) + 1, dtype=np.int32) * len(ranks), as_long(np.stack(ranks, 1).ravel())),
                    ], names=["id", "tag", "s", "e", "key", "extent", "ranks"])

    found = materialize(spark, named(docs).mapInArrow(survivors, "id bigint, tag bigint, s bigint, e bigint, key bigint, extent bigint, ranks array<bigint>"), "positions")

    # prefix doubling: a rank is judged only where the shorter one was shared
    shared = None
    levels, have, tables = 0, gram, []
    while have < window:
        have, levels = min(2 * have, window), levels + 1
    current = found.select("ranks")
    for level in range(levels):
        rank = F.col("ranks")[level]
        again = materialize(spark, current.groupBy(rank.alias("rank")).agg(F.count("*").alias("n")).where("n > 1").select("rank"), "ranks")
        tables.append(again)
        shared = again if shared is None else shared.union(again)
        if level + 1 < levels:
            current = current.withColumn("rank", rank).join(again, "rank", "left_semi").select("ranks")
    common_ranks = key_filter(spark, shared, "rank")

    extents = found.groupBy("key", "extent").agg(F.count("*").alias("n"))
    extents = materialize(spark, extents, "extents")
    whole = found.join(extents.where("n > 1").select("key", "extent"), ["key", "extent"], "left_semi").select("id", "tag", "s", "e")
    whole = materialize(spark, whole, "runs")
    mixed = materialize(spark, extents.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key"), "mixed")
    border = key_filter(spark, mixed)
    copied = key_filter(spark, extents.where("n > 1"), "extent")
    discard(spark, counts, found, extents, *tables)

    def windows(batches):
        unsure, common, seen, known = opened(border), opened(hot), opened(copied), opened(common_ranks)
        first: set[int] = set()
        for ids, tags, seqs, own in chunks(batches, _symbols):
            if len(first) > SEEN:
                first.clear()
            for b in blocks(seqs, window):
                a = Anchors(seqs, b, window, gram)
                pick = picked(a, unsure, own)
                extent = a.extent(pick)
                # of anchors with a shared extent one is enough for comparison: all their windows are removed already
                # (an extent that the filter takes for shared without cause is lone, and stays)
                keep = np.ones(len(pick), bool)
                _, lead = np.unique(extent, return_index=True)
                lone = np.zeros(len(pick), bool)
                lone[lead] = True
                again = seen.holds(extent)
                for k in np.flatnonzero(again).tolist():
                    if not lone[k] or int(extent[k]) in first:
                        keep[k] = False
                    else:
                        first.add(int(extent[k]))
                pick = pick[keep]
                ranks, lengths = doubled(a, pick)
                limit = a.hi[pick].copy()
                for rank, n in zip(reversed(ranks), reversed(lengths), strict=True):
                    # windows that hold a string of unique rank are unique
                    limit = np.where(known.holds(rank), limit, np.minimum(limit, a.at[pick] + n - window - 1))
                a.hi[pick] = limit
                pick = pick[a.lo[pick] <= limit]
                if len(pick):
                    yield window_rows(a, pick, ids, tags, common.holds(a.key[pick]))

    rest = repeated_windows(spark, with_own_keys(docs, _symbols, window, gram, mixed).mapInArrow(windows, WINDOW_ROWS), window)
    discard(spark, mixed)
    return gather_spans(rest.union(whole))


def cut_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in spans:
        parts.append(data[at:s])
        at = e
    return b"".join([*parts, data[at:]])


def _cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    kept = cut_bytes(data, spans)
    return len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are but for the text that remains and n_chars, its length.

    Characters cut in two by a removal are dropped; null texts stay null."""
    spans = repeated_bytes(spark, docs).select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), F.col("spans").alias("__spans"))
    d = docs.withColumn("__id", row_id()).withColumn("__tag", row_tag())
    joined = d.join(spans, ["__id", "__tag"], "left").select(*[d[f"`{c}`"] for c in docs.columns], "__spans")
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            texts = []
            for x, s in zip(b.column(at), b.column(b.num_columns - 1), strict=True):
                cut = s.as_py()
                texts.append(x.as_py() if not cut else cut_bytes(x.as_py().encode("utf-8", "replace"), merge(cut)).decode("utf-8", "ignore"))
            columns = b.columns[:-1]
            columns[at] = pa.array(texts, columns[at].type)
            if count is not None:
                columns[count] = pa.array([None if x is None else len(x) for x in texts], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return cut_texts(docs, repeated_bytes(spark, docs), _cut, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", ["n_bytes", "n_removed", "n_spans", "kept_sha256"])

