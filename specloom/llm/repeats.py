"""Steps common to the two repeat removers: counting anchors, filtering by key, resolving windows, cutting texts.

Rows are named by (id, tag): the document id and a hash of id and text, so rows of equal ids stay apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import as_long, materialize, mix, n_partitions, trim, with_columns_of
from specloom.llm.windows import Anchors, KeyFilter, blocks, filter_words

#: Largest key filter: 2**28 bits, 32 MB. With more keys it lets more rows pass that later steps drop; nothing is lost.
MAX_FILTER_BITS = 28
#: With more keys than these, which fill a 16th of that filter, documents are joined with those of their own.
MAX_KEYS = 1 << 24
#: Anchors that occur more often are told apart by whole windows, so no group grows with one passage.
HOT = 4096
#: Symbols of a task's documents handled together.
CHUNK = 2_000_000
#: Windows held while equal ones are searched.
HELD = 500_000


def named(docs: DataFrame) -> DataFrame:
    """id, tag, text of every row."""
    d = with_columns_of(docs, "doc_id", "text")
    return d.select(row_id().alias("id"), row_tag().alias("tag"), "text")


def row_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1).cast("bigint"))


def row_tag() -> Column:
    return F.xxhash64("doc_id", "text")


def chunks(batches, symbols: Callable[[bytes], np.ndarray]):
    """(ids, tags, symbol sequences, own keys) of some CHUNK symbols at a time; own keys: those of ``with_own_keys``
    told apart by sequence, in order, or None for batches without them."""
    ids, tags, seqs, own, size = [], [], [], [], 0

    def chunk():
        return np.array(ids, np.int64), np.array(tags, np.int64), seqs, np.sort(np.concatenate(own)) if own else None

    for b in batches:
        keys = b.column(3) if b.num_columns > 3 else None
        for k, (i, t, x) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)):
            v = symbols((x.as_py() or "").encode("utf-8", "replace"))
            if keys is not None:
                own.append(of_sequence(keys[k].values.to_numpy().view(np.uint64), len(ids)))
            ids.append(i)
            tags.append(t)
            seqs.append(v)
            size += len(v)
            if size >= CHUNK:
                yield chunk()
                ids, tags, seqs, own, size = [], [], [], [], 0
    if ids:
        yield chunk()
    del ids, tags, seqs, own
    trim()


def of_sequence(keys: np.ndarray, sequence) -> np.ndarray:
    """Hashes of keys and of the number of the sequence, or numbers of the sequences, that they are of."""
    return mix(keys + mix(np.atleast_1d(sequence).astype(np.uint64) + np.uint64(1)))


def picked(a: Anchors, wanted: KeyFilter, own: np.ndarray | None) -> np.ndarray:
    """The anchors whose key the filter holds and, where documents come with own keys, is one of these."""
    pick = np.flatnonzero(wanted.holds(a.key))
    if own is None:
        return pick
    if not len(own):
        return pick[:0]
    h = of_sequence(a.key[pick], a.seq[pick])
    return pick[own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h]


def with_own_keys(docs: DataFrame, symbols, length: int, gram: int, keys: DataFrame) -> DataFrame:
    """id, tag, text as of ``named`` where ``keys`` are few enough for a filter. Else only rows that have some of them,
    with an array of these, found by a join on the key: what goes on follows what is wanted at any number of keys."""
    if keys.count() <= MAX_KEYS:
        return named(docs)

    def run(batches):
        for ids, tags, seqs, _ in chunks(batches, symbols):
            for b in blocks(seqs, length):
                a = Anchors(seqs, b, length, gram)
                lead = np.unique(of_sequence(a.key, a.seq), return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a.seq[lead]]), pa.array(tags[a.seq[lead]]), pa.array(as_long(a.key[lead]))], names=["id", "tag", "key"])

    found = named(docs).mapInArrow(run, "id bigint, tag bigint, key bigint").join(keys.select("key"), "key", "left_semi")
    own = found.groupBy("id", "tag").agg(F.collect_set("key").alias("keys"))
    return named(docs).join(own, ["id", "tag"]).select("id", "tag", "text", "keys")


def anchor_counts(docs: DataFrame, symbols, length: int, gram: int) -> DataFrame:
    """key, n: the anchor strings that occur at least twice."""

    def run(batches):
        for _, _, seqs, _ in chunks(batches, symbols):
            keys = [Anchors(seqs, b, length, gram).key for b in blocks(seqs, length)]
            if keys:
                u, c = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(u)), pa.array(c.astype(np.int64))], names=["key", "n"])

    return named(docs).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def key_filter(spark: SparkSession, keys: DataFrame, column: str = "key"):
    """A broadcast KeyFilter of the values of ``column``; its size is bounded by MAX_FILTER_BITS."""
    n = keys.count()
    bits = min(MAX_FILTER_BITS, max(12, math.ceil(math.log2(16 * max(n, 1)))))
    top = F.shiftrightunsigned(F.col(column), 64 - bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))")
    words = keys.select(F.shiftrightunsigned(top, 6).alias("w"), bit.alias("b"))
    table = words.groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
    out = np.zeros(filter_words(bits), np.uint64)
    out[table.column("w").to_numpy()] = table.column("b").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast((bits, out))


def opened(frozen) -> KeyFilter:
    return KeyFilter(*frozen.value)


#: Parts that the occurrences of a hot window are dealt to.
SALTS = 64
#: wins: hashes of consecutive windows from lo on; or none, and e is the end of a run known to be repeated (else -1).
#: salt: 0, or for a hot window the part that its document falls to.
WINDOW_ROWS = "g bigint, id bigint, tag bigint, lo bigint, e bigint, wins binary, salt int"


def _runs(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of consecutive positions of one row."""
    brk = np.flatnonzero((np.diff(at) != 1) | (np.diff(row) != 0)) + 1
    return np.concatenate([[0], brk]).astype(np.int64), np.concatenate([brk - 1, [len(at) - 1]]).astype(np.int64)


def window_rows(anchors: Anchors, pick: np.ndarray, ids: np.ndarray, tags: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """Rows of WINDOW_ROWS: one per picked anchor, grouped by its key; for hot anchors one per window.

    Hot windows that are equal within this block are repeated for certain: their runs are sent as such and one of each
    stands for all, so that a window that a third of all documents share is sent once a block.
    """
    cold, warm = pick[~hot], pick[hot]
    lo = (anchors.lo - anchors.base).astype(np.int64)
    hashes, count = anchors.window_hashes(cold)
    g, owner, at, end, sizes = [anchors.key[cold]], [anchors.seq[cold]], [lo[cold]], [np.full(len(cold), -1)], [count]
    salt = [np.zeros(len(cold), np.int32)]
    each, n = anchors.window_hashes(warm)
    if len(each):
        row = np.repeat(np.arange(len(warm)), n)
        pos = np.arange(len(each)) - np.repeat(np.cumsum(n) - n - lo[warm], n)
        _, lead, back, times = np.unique(each, return_index=True, return_inverse=True, return_counts=True)
        g.append(each[lead])
        owner.append(anchors.seq[warm][row[lead]])
        at.append(pos[lead])
        end.append(np.full(len(lead), -1))
        sizes.append(np.ones(len(lead), np.int64))
        salt.append((mix(tags[owner[-1]].view(np.uint64)) % np.uint64(SALTS)).astype(np.int32) + 1)
        hashes = np.concatenate([hashes, each[lead]])
        again = np.flatnonzero(times[back] > 1)
        if len(again):
            b, e = _runs(row[again], pos[again])
            first = again[b]
            g.append(mix(pos[first].astype(np.uint64) + tags[anchors.seq[warm][row[first]]].view(np.uint64)))
            owner.append(anchors.seq[warm][row[first]])
            at.append(pos[first])
            end.append(pos[again[e]] + anchors.length)
            sizes.append(np.zeros(len(b), np.int64))
            salt.append(np.zeros(len(b), np.int32))
    g, owner, at, end, sizes = (np.concatenate(x) for x in (g, owner, at, end, sizes))
    offsets = np.concatenate([[0], 8 * np.cumsum(sizes)]).astype(np.int32)
    wins = pa.Array.from_buffers(pa.binary(), len(g), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(hashes))])
    return pa.RecordBatch.from_arrays([pa.array(as_long(g)), pa.array(ids[owner]), pa.array(tags[owner]), pa.array(at.astype(np.int64)), pa.array(end.astype(np.int64)), wins, pa.array(np.concatenate(salt))], names=["g", "id", "tag", "lo", "e", "wins", "salt"])


def repeated_windows(spark: SparkSession, rows: DataFrame, length: int) -> DataFrame:
    """id, tag, s, e: runs of symbols covered by windows that occur more than once among ``rows`` (WINDOW_ROWS).

    Equal windows have equal g, so each partition, sorted by g, is searched in portions that end between groups. Those
    of a hot window are dealt to SALTS parts: a part with several of them settles its own and sends word of it, a part
    with one sends that one, and a second step joins what the parts of a window sent, a row each.
    """

    def search(t: pa.Table):
        wins = t.column("wins").combine_chunks()
        wins = pa.concat_arrays(wins.chunks) if isinstance(wins, pa.ChunkedArray) else wins
        bounds = np.frombuffer(wins.buffers()[1], np.int32)[wins.offset : wins.offset + len(wins) + 1]
        sizes = np.diff(bounds).astype(np.int64) // 8
        total = int(sizes.sum())
        h = np.frombuffer(wins.buffers()[2], np.uint64, total, int(bounds[0])) if total else np.zeros(0, np.uint64)
        g, lo, known, salt = (t.column(c).to_numpy() for c in ("g", "lo", "e", "salt"))
        row = np.repeat(np.arange(len(sizes)), sizes)
        # windows are equal if both their hashes and their groups are
        order = np.lexsort((h, g[row]))
        eq = (h[order][1:] == h[order][:-1]) & (g[row[order]][1:] == g[row[order]][:-1])
        dup = np.zeros(len(h), bool)
        dup[order[1:][eq]] = True
        dup[order[:-1][eq]] = True
        at = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes - lo, sizes)
        k = np.flatnonzero(dup)
        owner, s, e = [np.flatnonzero(known >= 0)], [lo[known >= 0]], [known[known >= 0]]
        kind = [np.zeros(len(owner[0]), np.int8)]
        if len(k):
            first, last = _runs(row[k], at[k])
            owner.append(row[k[first]])
            s.append(at[k[first]])
            e.append(at[k[last]] + length)
            kind.append(np.zeros(len(first), np.int8))
        hot = np.flatnonzero(salt[row] > 0)
        if len(hot):
            lone = hot[~dup[hot]]
            _, lead = np.unique(g[row[hot[dup[hot]]]], return_index=True)
            word = hot[dup[hot]][lead]
            for some, what in ((lone, 1), (word, 2)):
                owner.append(row[some])
                s.append(at[some])
                e.append(at[some] + length)
                kind.append(np.full(len(some), what, np.int8))
        owner, s, e, kind = (np.concatenate(x) for x in (owner, s, e, kind))
        if not len(owner):
            return None
        return pa.RecordBatch.from_arrays([pa.array(t.column("id").to_numpy()[owner]), pa.array(t.column("tag").to_numpy()[owner]), pa.array(s), pa.array(e), pa.array(g[owner]), pa.array(kind)], names=["id", "tag", "s", "e", "g", "kind"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows + b.column(5).nbytes // 8
            if size < HELD:
                continue
            t = pa.Table.from_batches(held)
            g, salt = t.column("g").to_numpy(), t.column("salt").to_numpy()
            other = np.flatnonzero((g != g[-1]) | (salt != salt[-1]))
            if len(other):
                cut = int(other[-1]) + 1
                if (out := search(t.slice(0, cut))) is not None:
                    yield out
                t = t.slice(cut)
            held = t.to_batches()
            size = 0
        if held and (out := search(pa.Table.from_batches(held))) is not None:
            yield out
        trim()

    dealt = rows.repartition(n_partitions(spark), "g", "salt").sortWithinPartitions("g", "salt")
    found = materialize(spark, dealt.mapInArrow(run, "id bigint, tag bigint, s bigint, e bigint, g bigint, kind tinyint"), "runs")
    sent = found.where("kind > 0")
    again = sent.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    lone = sent.where("kind = 1").join(again, "g", "left_semi")
    return found.where("kind = 0").select("id", "tag", "s", "e").union(lone.select("id", "tag", "s", "e"))


def gather_spans(spans: DataFrame) -> DataFrame:
    """id, tag, spans: the runs of each document, of which there are at most as many as it has symbols."""
    return spans.distinct().groupBy("id", "tag").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merge(spans: list[dict]) -> list[tuple[int, int]]:
    """Union of runs, in order; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def cut_texts(docs: DataFrame, spans: DataFrame, cut: Callable, schema: str, names: list[str]) -> DataFrame:
    """Each document's row from ``cut(data, merged spans)``; ``names`` and ``schema`` are those of its values."""
    d = with_columns_of(docs, "doc_id", "text").withColumn("id", row_id()).withColumn("tag", row_tag())
    joined = d.join(spans, ["id", "tag"], "left").select("doc_id", "text", "spans")
    kinds = [f.dataType for f in joined.select("doc_id").schema]

    def run(batches):
        for b in batches:
            out = [cut((x.as_py() or "").encode("utf-8", "replace"), merge(s.as_py() or [])) for x, s in zip(b.column(1), b.column(2), strict=True)]
            columns = [pa.array(list(c)) for c in zip(*out, strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", *names])

    return joined.mapInArrow(run, f"doc_id {kinds[0].simpleString()}, {schema}")
