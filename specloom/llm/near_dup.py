"""Near duplicates by an inverted join of MinHash signature coordinates.

A document is the set of its distinct word shingles, hashed to 64 bits; its signature has ``COORDINATES`` minima.
Documents of equal sets form a class, which one node stands for: copies are membership, never pairs. Two sets of the
least similarity agree in at least ``matches_for`` coordinates but for about two pairs in a million.

1. Order. Each coordinate-value pair is a key. A table of ``BUCKETS`` counters, of one size whatever the input, tells
   about how common the keys of a bucket are; by it, then by value, all keys have one order.
2. Prefix merging. A node is posted under its rarest keys only, one more than coordinates may differ: two nodes that
   agree in enough coordinates share one of them. The common keys are skipped: no list is made for them.
3. Representatives. Every node is paired with one of the smallest nodes of its lists, the one it collides with in most
   of them; confirmed links join nodes to components.
4. Lists whose nodes are in one component are skipped. Of the nodes of lists longer than ``TILE`` only those go on whose
   rarest shingles, one more than a qualifying partner may lack, are also among those of a node of another component: sets
   that share a template and differ in the rest meet in lists of signatures, but not here. In the lists that remain, cut
   in blocks of ``TILE`` nodes, the nodes outside the list's largest component count their collisions with all others. One that reaches the match threshold with a
   node of another component is sent, once, to the group of that node: its component, or that of its representative.
5. There it is compared with the full sets of the group's members, block by block, and of the links found in a block
   those go out that join components. So what is sent and returned grows with nodes and blocks, not with pairs.

Defined results: texts without words and null texts have an empty set and are linked with nothing; rows of equal doc_id
are kept apart but share ids; a null doc_id is never kept and has the component of the others of its class, or null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import LOWER, as_long, documents, drop, materialize, mix, n_partitions, release, to_bytes, trim, with_columns_of, words_of
from specloom.llm.components import connected_components

COORDINATES = 128
#: Share of qualifying pairs that may agree in fewer coordinates than are asked for.
MISSES = 2e-6
#: Counters of keys, a byte each where they are broadcast, and how many of them a row of their sums holds.
BUCKET_BITS, BLOCK_BITS = 22, 14
TILE = 1024
#: Members, and shingles of them, that a block of a group holds.
MEMBERS, ITEMS = 512, 400_000


def matches_for(percent: int, coordinates: int = COORDINATES) -> int:
    """Coordinates in which sets of this similarity agree but for MISSES of them: a tail of the binomial distribution."""
    p, tail, k = min(percent, 99) / 100, 0.0, 0
    while True:
        tail += math.exp(math.lgamma(coordinates + 1) - math.lgamma(k + 1) - math.lgamma(coordinates - k + 1) + k * math.log(p) + (coordinates - k) * math.log1p(-p))
        if tail > MISSES:
            return k
        k += 1


_RNG = np.random.default_rng(5)
_A = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_STEP = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x9E3779B185EBCA87)]


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles of a text; the whole sequence if it has fewer words."""
    _, _, h = words_of(to_bytes(text).translate(LOWER))
    if not len(h):
        return h
    if len(h) < size:
        x = np.full(1, len(h), np.uint64)
        for w in h:
            x = mix(x * _STEP[0] + w)
        return x
    n = len(h) - size + 1
    x = np.zeros(n, np.uint64)
    for k in range(size):
        x = mix(x * _STEP[k % len(_STEP)] + h[k : k + n])
    return np.unique(x)


def keys_of(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 64-bit coordinate-value keys for each set, none of which may be empty."""
    out = np.empty((len(sets), COORDINATES), np.uint64)
    if not sets:
        return out
    at = np.cumsum([0, *map(len, sets)])[:-1]
    values = np.concatenate(sets)
    for k in range(COORDINATES):
        out[:, k] = mix(np.minimum.reduceat(values * _A[k] + _B[k], at) * _STEP[1] + np.uint64(k))
    return out


def node_of(x: np.ndarray) -> int:
    """The name of a set that is not empty: a hash of its contents."""
    return int(np.bitwise_xor.reduce(mix(x + np.uint64(len(x)))).view(np.int64))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, tag, text: rows are named by their id, null or not, and a hash of id and text."""
    return with_columns_of(docs, "doc_id", "text").select("doc_id", F.xxhash64("doc_id", "text").alias("tag"), "text")


def describe(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, tag, n, node (a hash of the set), keys of every row; no node where the set is empty."""

    def some(b, sets):
        full = [k for k, x in enumerate(sets) if len(x)]
        keys = iter([x.tobytes() for x in keys_of([sets[k] for k in full])])
        nodes = [node_of(x) if len(x) else None for x in sets]
        n = pa.array([len(x) for x in sets], pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pa.array(nodes, pa.int64()), pa.array([next(keys) if len(x) else None for x in sets], pa.binary())], names=["doc_id", "tag", "n", "node", "keys"])

    def run(batches):
        for b in batches:
            sets, total, first = [], 0, 0
            for k, x in enumerate(b.column(2)):
                sets.append(shingles(x.as_py(), size))
                total += len(sets[-1])
                if total > 500_000:
                    yield some(b.slice(first, len(sets)), sets)
                    sets, total, first = [], 0, k + 1
            if sets:
                yield some(b.slice(first, len(sets)), sets)
        trim()

    source = identified(docs)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, tag bigint, n bigint, node bigint, keys binary")


def _key_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, COORDINATES)


def commonness(spark: SparkSession, rows: DataFrame) -> np.ndarray:
    """For each bucket of the 64-bit keys in the first column, a byte that grows with the logarithm of its count: BUCKETS bytes, whatever the input."""
    shift, low = np.uint64(64 - BUCKET_BITS), (1 << BLOCK_BITS) - 1

    def count(batches):
        seen = np.zeros(1 << BUCKET_BITS, np.uint32)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                u, c = np.unique(np.frombuffer(b"".join(b.column(0).slice(at, 1000).to_pylist()), np.uint64) >> shift, return_counts=True)
                seen[u.astype(np.int64)] += c.astype(np.uint32)
        at = np.flatnonzero(seen)
        block = at >> BLOCK_BITS
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(block)) + 1):
            if len(part):
                data = np.stack([(at[part] & low).astype(np.uint32), seen[at[part]]]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block[part[0]]], pa.int64()), pa.array([data], pa.binary())], names=["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, c = np.frombuffer(data, np.uint32).reshape(2, -1)
                total = sums.setdefault(block, np.zeros(1 << BLOCK_BITS, np.uint64))
                total[at] += c
        for block, total in sums.items():
            code = np.minimum(255, np.log2(total + 1.0) * 6).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([code.tobytes()], pa.binary())], names=["block", "codes"])

    schema = "block bigint, {} binary"
    parts = rows.mapInArrow(count, schema.format("counts"))
    out = np.zeros(1 << BUCKET_BITS, np.uint8)
    for r in parts.repartition(n_partitions(spark), "block").mapInArrow(add, schema.format("codes")).collect():
        out[r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] = np.frombuffer(r["codes"], np.uint8)
    return out


def ranked(spark: SparkSession, rows: DataFrame, matches: int) -> DataFrame:
    """doc_id, tag, n, node, prefix (the rarest keys, as many as any qualifying pair must share one of), sig (16 bits of each key)."""
    frozen, length = spark.sparkContext.broadcast(commonness(spark, rows.where("keys IS NOT NULL").select("keys"))), COORDINATES - matches + 1

    def run(batches):
        common = frozen.value
        for big in batches:
            for at in range(0, big.num_rows, 4000):
                b = big.slice(at, 4000)
                keys = _key_rows(b.column(4))
                order = (common[(keys >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (keys >> np.uint64(8))
                rare = np.take_along_axis(keys, np.argpartition(order, length - 1, axis=1)[:, :length], 1)
                prefix = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * length, as_long(np.ascontiguousarray(rare).ravel()))
                sig = pa.array([x.tobytes() for x in (keys >> np.uint64(48)).astype(np.uint16)], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[:4], prefix, sig], names=["doc_id", "tag", "n", "node", "prefix", "sig"])
        trim()

    full = rows.where("node IS NOT NULL")
    return full.mapInArrow(run, f"doc_id {full.schema['doc_id'].dataType.simpleString()}, tag bigint, n bigint, node bigint, prefix array<bigint>, sig binary")


def _agree(pairs: DataFrame, nodes: DataFrame, matches: int) -> DataFrame:
    """Pairs a, b whose signatures agree in so many coordinates."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(-1, COORDINATES)
                y = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint16).reshape(-1, COORDINATES)
                yield b.select([0, 1]).filter(pa.array((x == y).sum(1) >= matches))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on their full sets."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}"))

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int(np.isin(x, y, assume_unique=True, kind="sort").sum()) if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) else 0
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "items_a", "items_b").mapInArrow(run, "a bigint, b bigint")


def _full_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, items: the hashed sets of the given nodes, from the text of one document each."""

    def run(batches):
        for b in batches:
            for node, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = shingles(text.as_py(), size)
                if len(x) and node_of(x) == node:
                    yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["node", "items"])

    source = identified(docs).join(nodes.select("tag", "node"), "tag")
    # rows of equal tag hold equal texts; by the hash of the set, no other one passes
    return source.select("node", "text").mapInArrow(run, "node bigint, items binary").dropDuplicates(["node"])


def rarest(spark: SparkSession, sets: DataFrame, percent: int) -> DataFrame:
    """node, s: the rarest shingles of each set, so many that sets of this similarity have one of them in common."""
    frozen = spark.sparkContext.broadcast(commonness(spark, sets.select("items")))

    def run(batches):
        common = frozen.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, out, n = b.slice(at, 500), [], []
                for data in part.column(1):
                    x = np.frombuffer(data.as_buffer(), np.uint64)
                    length = len(x) + percent * len(x) // -100 + 1  # a partner holds the share of it at least
                    order = (common[(x >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (x >> np.uint64(8))
                    # shingles that are equal in this order stand side by side, so that both sets cut it alike
                    out.append(x[np.lexsort((x, order))[:length]])
                    n.append(len(out[-1]))
                node = np.repeat(part.column(0).to_numpy(), n)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(as_long(np.concatenate(out)))], names=["node", "s"])
        trim()

    return sets.select("node", "items").mapInArrow(run, "node bigint, s bigint")


def _within_reach(spark: SparkSession, named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node: of ``named`` (node, label) with ``sets``, those that share a rare shingle with a node of another label."""
    post = rarest(spark, sets, percent).join(named, "node")
    shared = post.groupBy("s").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("s")
    return post.join(shared, "s", "left_semi").select("node").distinct()


def _segments(batches, width: int):
    """(number, rows) of sorted batches, cut where the first ``width`` columns change; a number may come several times."""
    number, last = -1, None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(c).to_numpy() for c in range(width)])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            if last is None or (key[:, i] != last).any():
                number, last = number + 1, key[:, i]
            yield number, b.slice(i, j - i)


def _routes(blocks: DataFrame, matches: int) -> DataFrame:
    """node, home: of ``blocks`` (key, blk, q, node, label, home, major, sig), the queries that reach the match threshold
    with a member of another component, and that member's home. Of two queries the smaller one is sent."""

    def run(batches):
        current, held, members = -1, [], None
        for number, b in _segments(batches, 2):
            if number != current:
                current, held, members = number, [], None
            q = b.column(2).to_numpy()
            if (q == 0).any():
                held.append(b.slice(0, int((q == 0).sum())))
            if not (q == 1).any():
                continue
            if not held:  # no member fell into this block
                continue
            if members is None:
                t = pa.Table.from_batches(held)
                members = (*(t.column(c).to_numpy() for c in (3, 4, 5, 6)), np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint16).reshape(-1, COORDINATES))
            node, label, home, major, sig = members
            b = b.slice(int((q == 0).sum()))
            xs, homes = [], []
            for x, l, s in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(7).to_pylist(), strict=True):
                at = np.flatnonzero((label != l) & ((label == major) | (node > x)))
                if len(at):
                    found = np.unique(home[at[(sig[at] == np.frombuffer(s, np.uint16)).sum(1) >= matches]])
                    xs += [x] * len(found)
                    homes += found.tolist()
            if xs:
                yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(homes, pa.int64())], names=["node", "home"])

    return blocks.mapInArrow(run, "node bigint, home bigint")


def _linked(blocks: DataFrame, percent: int) -> DataFrame:
    """a, b: of ``blocks`` (home, blk, q, node, label, items), links of queries with members that join components."""

    def run(batches):
        current, held, members, top = -1, [], None, {}

        def find(x: int) -> int:
            while (up := top.get(x, x)) != x:
                top[x] = top.get(up, up)
                x = up
            return x

        for number, b in _segments(batches, 2):
            if number != current:
                current, held, members, top = number, [], None, {}
            q = b.column(2).to_numpy()
            k = int((q == 0).sum())
            if k:
                held.append(b.slice(0, k))
            if k == b.num_rows:
                continue
            if not held:
                continue
            if members is None:
                t = pa.Table.from_batches(held)
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column(5)]
                sizes = np.array([len(x) for x in sets])
                values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                order = np.argsort(values, kind="stable")
                members = t.column(3).to_pylist(), t.column(4).to_numpy(), sizes, values[order], owner[order]
            node, label, sizes, values, owner = members
            rows = b.slice(k)
            a_, b_ = [], []
            for x, l, data in zip(rows.column(3).to_pylist(), rows.column(4).to_pylist(), rows.column(5), strict=True):
                own = np.frombuffer(data.as_buffer(), np.uint64)
                lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                n = hi - lo
                at = np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)
                both = np.bincount(owner[at], minlength=len(sizes))
                for y in np.flatnonzero((100 * both >= percent * (len(own) + sizes - both)) & (label != l)).tolist():
                    r, s = find(l), find(int(label[y]))
                    if r != s:
                        top[max(r, s)] = min(r, s)
                        a_.append(min(x, node[y]))
                        b_.append(max(x, node[y]))
            if a_:
                yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], names=["a", "b"])
        trim()

    return blocks.mapInArrow(run, "a bigint, b bigint")


def _merged(spark: SparkSession, labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, label after the components that ``links`` connect become one; only labels pass through the search."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    named = links.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")})
    named = materialize(spark, named, "named")
    top = connected_components(spark, named.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    every = labels.select("node", "label").union(named.select("a", "la")).union(named.select("b", "lb")).distinct()
    top = top.select(F.col("node").alias("label"), F.col("label").alias("least"))
    return materialize(spark, every.join(top, "label", "left").select("node", F.coalesce("least", "label").alias("label")), "labels")


def _sorted(spark: SparkSession, blocks: DataFrame, key: str) -> DataFrame:
    return blocks.repartition(n_partitions(spark), key, "blk").sortWithinPartitions(key, "blk", "q")


def labelled_rows(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, tag, n, label of every row: rows of one label are connected by links; no label where the set is empty."""
    matches, spent = matches_for(percent), []

    def table(df: DataFrame, name: str) -> DataFrame:
        spent.append(materialize(spark, df, name))
        return spent[-1]

    described = materialize(spark, describe(docs, size), "signatures")
    rows = materialize(spark, described.select("doc_id", "tag", "n", "node"), "rows")
    nodes = table(ranked(spark, described, matches).groupBy("node").agg(F.first("tag").alias("tag"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sig").alias("sig")), "nodes")
    drop(spark, described)
    post = nodes.select("node", F.explode("prefix").alias("key"))
    lists = post.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("m")).where("m > 1")
    post = table(post.join(lists, "key").select("key", "node", "a"), "postings")
    release(spark)

    # of the lists' smallest nodes, the one that a node meets in most lists
    met = post.where("a <> node").groupBy("node", "a").agg(F.count("*").alias("c"))
    stars = table(met.groupBy(F.col("node").alias("b")).agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b"), "stars")
    first = table(_agree(stars, nodes, matches), "pairs")
    ids = first.select("a").union(first.select("b")).distinct().select(F.col("a").alias("node"))
    sets = table(_full_sets(docs, nodes.join(ids, "node", "left_semi"), size), "sets")
    links = table(_confirm(first, sets, percent), "links")
    labels = connected_components(spark, links)
    release(spark)

    # every posted node's label and home, its component or that of its representative
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    named = post.select("node").distinct().join(stars.select(F.col("b").alias("node"), "a"), "node", "left").join(of("node"), "node", "left").join(of("a"), "a", "left")
    named = table(named.select("node", F.coalesce("lnode", "node").alias("label"), F.coalesce("lnode", "la", "a", "node").alias("home")), "named")

    # lists of several components; of those of more than one block only nodes that are within reach of another component
    def several(rows: DataFrame) -> DataFrame:
        shares = rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key")
        return shares.agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.sum("c").alias("m"), F.count("*").alias("kinds")).where("kinds > 1")

    labelled = post.select("key", "node").join(named, "node")
    mixed = table(several(labelled).withColumn("large", F.col("m") > TILE).select("key", "large"), "mixed")
    labelled = labelled.join(mixed, "key")
    if not mixed.where("large").isEmpty():
        labelled = table(labelled, "mixed")
        asked = table(labelled.where("large").select("node", "label").distinct(), "asked")
        more = asked.select("node").join(sets.select("node"), "node", "left_anti")
        sets = sets.union(table(_full_sets(docs, nodes.join(more, "node", "left_semi"), size), "sets"))
        near = table(_within_reach(spark, asked, sets.join(asked.select("node"), "node", "left_semi"), percent), "near")
        labelled = labelled.where("NOT large").union(labelled.where("large").join(near, "node", "left_semi").select(labelled.columns))
        release(spark)
    labelled = labelled.drop("large")

    # blocks of members, and their nodes outside the largest component as queries of each
    lists = several(labelled).select("key", "major", F.ceil(F.col("m") / TILE).cast("int").alias("t"))
    open_ = table(labelled.join(lists, "key"), "open")
    own = F.pmod(F.xxhash64("node"), "t").cast("int")
    cells = open_.select("key", own.alias("blk"), F.lit(0).alias("q"), "node", "label", "home", "major")
    asked = open_.where("label <> major").select("key", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("blk"), F.lit(1).alias("q"), "node", "label", "home", "major")
    blocks = cells.union(asked).join(nodes.select("node", "sig"), "node").select("key", "blk", "q", "node", "label", "home", "major", "sig")
    routes = table(_routes(_sorted(spark, blocks, "key"), matches).distinct(), "routes")
    release(spark)
    if not routes.isEmpty():
        called = routes.select("home").distinct()
        members = table(named.join(called, "home", "left_semi"), "members")
        ids = members.select("node").union(routes.select("node")).distinct().join(sets.select("node"), "node", "left_anti")
        sets = sets.union(table(_full_sets(docs, nodes.join(ids, "node", "left_semi"), size), "sets"))
        counted = members.join(nodes.select("node", "n"), "node").groupBy("home").agg(F.count("*").alias("k"), F.sum("n").alias("items"))
        counted = counted.select("home", F.greatest(F.ceil(F.col("k") / MEMBERS), F.ceil(F.col("items") / ITEMS)).cast("int").alias("t"))
        cells = members.join(counted, "home").select("home", own.alias("blk"), F.lit(0).alias("q"), "node", "label")
        asked = routes.join(counted, "home").select("home", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("blk"), F.lit(1).alias("q"), "node")
        asked = asked.join(named.select("node", "label"), "node").select("home", "blk", "q", "node", "label")
        blocks = cells.union(asked).join(sets, "node").select("home", "blk", "q", "node", "label", "items")
        extra = table(_linked(_sorted(spark, blocks, "home"), percent), "links")
        if not extra.isEmpty():
            labels = _merged(spark, labels, extra)
        release(spark)
    drop(spark, *spent)
    return rows.join(labels, "node", "left").select("doc_id", "tag", "n", F.coalesce("label", "node").alias("label"))


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: components of the links of ``percent`` similarity or more."""
    own = labelled_rows(spark, docs, size, percent)
    least = own.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = own.join(least, "label", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_first(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns as they are, one of each group of linked rows: that of smallest id, null last.

    Rows are told apart by id and text, so a row goes only for its own text's sake. Rows of one id and text are copies,
    of which one stays. Rows without words belong to no group and stay."""
    rows = materialize(spark, labelled_rows(spark, docs, size, percent).where("label IS NOT NULL").select("doc_id", "tag", "label"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    first = rows.groupBy("label").agg(F.min(order).alias("w")).select("label", F.col("w.tag").alias("first"))
    by_tag = rows.groupBy("tag", "label").agg(F.count("*").alias("n")).join(first, "label")
    by_tag = materialize(spark, by_tag.where("n > 1 OR tag <> first").select(F.col("tag").alias("__tag"), (F.col("tag") == F.col("first")).alias("one")), "tags")
    d = docs.withColumn("__tag", F.xxhash64("doc_id", "text"))
    whole = d.join(by_tag.select("__tag"), "__tag", "left_anti")
    again = d.join(by_tag.where("one").select("__tag"), "__tag", "left_semi").dropDuplicates(["__tag"])
    return whole.select(*docs.columns).union(again.select(*docs.columns))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, documents(spark, sf_dir), size=3, percent=85)
