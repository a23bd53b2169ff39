"""A manifest of digests over a dataset: one tree per language, one tree over their roots, a proof for every row.

Rows are leaves. Within a tree nodes are numbered in order and every FAN consecutive ones become the hash of their
digests, level by level, until one remains. An aligned block of FAN ** LEVELS nodes is a whole subtree, so blocks are
traversed in parallel: a recursive postorder walk returns a subtree's digest and, while it unwinds, appends each child's
siblings to the leaves under it. The blocks' roots are the nodes of the next, smaller round; what that round appends to a
block is joined to its leaves. Rounds go on until each tree is one node.

Positions come from a range partitioning by (tree, order) with sizes per partition added up, so neither a language that
holds most rows nor rows that are equal throughout meet in one task. Equal order values are ordered by their digests;
rows equal in all are leaves of their own. Null values are hashed as '-', a null language is a tree of its own (the first).
An empty table gives no rows. Columns that are not hashed are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.llm.common import documents, materialize, n_partitions, trim, with_columns_of

FAN = 8
#: Levels that one traversal climbs, so that blocks have 4096 nodes.
LEVELS = 4
#: Partition sizes (a row for each partition and each tree) are broadcast up to this number, some 5 MB.
BROADCAST_ROWS = 100_000
#: The hashed columns, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def record_digest(values: list[Column]) -> Column:
    """SHA-256 (binary) over values, each as byte count, ':' and text, null as '-'."""

    def framed(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(framed, values)), 256))


def numbered(spark: SparkSession, nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (with column tree) with pos, its number within its tree by ``order`` (nulls first), and size, the tree's nodes."""
    by = ["tree", *order, "_salt"]  # the salt deals out rows that are equal throughout; their order makes no difference
    dealt = nodes.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(n_partitions(spark), *by).sortWithinPartitions(*by)
    dealt = materialize(spark, dealt.drop("_salt").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "leaves")
    held = dealt.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("tree").orderBy("_part")) - F.col("_n")
    held = held.select(F.col("tree").alias("_tree"), F.col("_part").alias("_p"), "_first", before.alias("_before"), F.sum("_n").over(Window.partitionBy("tree")).alias("size"))
    if held.count() <= BROADCAST_ROWS:
        held = F.broadcast(held)
    out = dealt.join(held, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_tree", "_p", "_part", "_at", "_first", "_before")


def _walk(leaves: list[bytes], levels: int) -> tuple[bytes, list[list[bytes]], list[bytearray]]:
    """The root of ``leaves`` after so many levels, and for every leaf its siblings and its path (slot, run size; a byte each), upwards."""
    siblings: list[list[bytes]] = [[] for _ in leaves]
    path = [bytearray() for _ in leaves]

    def visit(lo: int, hi: int, level: int) -> bytes:
        if level == 0:
            return leaves[lo]
        width = FAN ** (level - 1)
        children = [visit(a, min(a + width, hi), level - 1) for a in range(lo, hi, width)]
        for slot in range(len(children)):
            others = b"".join(children[:slot] + children[slot + 1 :])
            for leaf in range(lo + slot * width, min(lo + (slot + 1) * width, hi)):
                siblings[leaf].append(others)
                path[leaf] += bytes((slot, len(children)))
        return parent(children)

    return visit(0, len(leaves), levels), siblings, path


def parent(children: list[bytes]) -> bytes:
    """Hash of the hexadecimal texts of digests."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def levels_of(size: int, most: int) -> int:
    """Levels to climb in a block of a tree of ``size`` nodes: until one remains, or to the top of a whole block."""
    n, levels = size, 0
    while n > 1 and levels < most:
        n, levels = -(-n // FAN), levels + 1
    return levels


def traverse(spark: SparkSession, nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (tree, pos, size, digest and others) with block, the siblings and path of each in its block, and the block's root.

    Partitions are read block by block, so a task holds one block and one batch of rows."""
    d = nodes.withColumn("block", F.expr(f"pos div {FAN**levels}")).repartition(n_partitions(spark), "tree", "block").sortWithinPartitions("tree", "block", "pos")
    names = d.columns
    it, ib, iz, ig = (names.index(c) for c in ("tree", "block", "size", "digest"))

    def climbed(t: pa.Table):
        size, leaves = t.column(iz)[0].as_py(), t.column(ig).to_pylist()
        root, siblings, path = _walk(leaves, levels_of(size, levels))
        more = [pa.array([b"".join(s) for s in siblings], pa.binary()), pa.array([bytes(p) for p in path], pa.binary()), pa.array([root] * len(leaves), pa.binary())]
        t = t.combine_chunks()
        yield from pa.Table.from_arrays([*t.columns, *more], names=[*names, "siblings", "path", "block_root"]).to_batches()

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            keys = list(zip(b.column(it).to_pylist(), b.column(ib).to_pylist(), strict=True))
            at = 0
            for i, k in enumerate(keys):
                if k != key:
                    if i > at:
                        held.append(b.slice(at, i - at))
                    if held:
                        yield from climbed(pa.Table.from_batches(held))
                    held, key, at = [], k, i
            if at < len(keys):
                held.append(b.slice(at))
        if held:
            yield from climbed(pa.Table.from_batches(held))
        trim()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    return d.mapInArrow(run, f"{kinds}, siblings binary, path binary, block_root binary")


def climb(spark: SparkSession, nodes: DataFrame, levels: int) -> DataFrame:
    """tree, pos, siblings, path and top (the tree's root) for every node of (tree, pos, size, digest)."""
    if nodes.where("size > 1").isEmpty():
        return nodes.select("tree", "pos", F.lit(b"").alias("siblings"), F.lit(b"").alias("path"), F.col("digest").alias("top"))
    low = materialize(spark, traverse(spark, nodes, levels), "blocks")
    return joined(low, climb(spark, block_roots(low, levels), levels)).select("tree", "pos", "siblings", "path", "top")


def block_roots(low: DataFrame, levels: int) -> DataFrame:
    width = FAN**levels
    return low.where(F.col("pos") % width == 0).select("tree", F.col("block").alias("pos"), F.expr(f"(size + {width - 1}) div {width}").alias("size"), F.col("block_root").alias("digest"))


def joined(low: DataFrame, high: DataFrame) -> DataFrame:
    """Nodes with what the round above appends to their blocks."""
    h = high.select(F.col("tree").alias("_tree"), F.col("pos").alias("_block"), F.col("siblings").alias("_siblings"), F.col("path").alias("_path"), *[c for c in high.columns if c not in ("tree", "pos", "siblings", "path")])
    out = low.join(h, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")))
    return out.withColumns({"siblings": F.concat("siblings", "_siblings"), "path": F.concat("path", "_path")}).drop("_tree", "_block", "_siblings", "_path")


def manifest(spark: SparkSession, rows: DataFrame, order: list[str], levels: int = LEVELS) -> DataFrame:
    """``rows`` (tree, digest, the columns of ``order`` and others) with siblings, path, subroot and root of each (binary)."""
    low = materialize(spark, traverse(spark, numbered(spark, rows, [*order, "digest"]), levels), "blocks")
    trees = materialize(spark, climb(spark, block_roots(low, levels), levels), "trees")
    roots = trees.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest"))
    forest = numbered(spark, roots, ["name"])
    above = climb(spark, forest.select("tree", "pos", "size", "digest"), levels).select(F.col("pos").alias("_place"), F.col("siblings").alias("_s"), F.col("path").alias("_p"), F.col("top").alias("root"))
    named = forest.select(F.col("name").alias("_name"), F.col("pos").alias("_at")).join(above, F.col("_at") == F.col("_place")).drop("_at", "_place")
    whole = trees.join(named, F.col("tree").eqNullSafe(F.col("_name"))).select("tree", "pos", F.concat("siblings", "_s").alias("siblings"), F.concat("path", "_p").alias("path"), F.col("top").alias("subroot"), "root")
    return joined(low, whole)


def fold(leaf: bytes, siblings: bytes, path: bytes) -> bytes:
    """The root that a leaf digest gives with its proof."""
    at, width = 0, len(leaf)
    for k in range(0, len(path), 2):
        slot, n = path[k], path[k + 1]
        run = siblings[at : at + (n - 1) * width]
        leaf = hashlib.sha256((run[: slot * width] + leaf + run[slot * width :]).hex().encode()).digest()
        at += (n - 1) * width
    return leaf


def folded(rows: DataFrame, leaf: str) -> DataFrame:
    """``rows`` with folded, the root that the digest in column ``leaf`` gives with each row's siblings and path."""
    names = rows.columns
    il, i_s, ip = (names.index(c) for c in (leaf, "siblings", "path"))

    def run(batches):
        for b in batches:
            out = [fold(*x) for x in zip(b.column(il).to_pylist(), b.column(i_s).to_pylist(), b.column(ip).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*names, "folded"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", folded binary")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str, levels: int = LEVELS) -> DataFrame:
    d = with_columns_of(documents(spark, sf_dir), *FIELDS)
    lowered = F.translate("text", _UPPER, _UPPER.lower())
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    tampered = F.when(changed, record_digest([*map(F.col, FIELDS[:-1]), lowered]))
    rows = d.select(F.col("lang").alias("tree"), "doc_id", record_digest([*map(F.col, FIELDS)]).alias("digest"), tampered.alias("tampered"))
    m = manifest(spark, rows, ["doc_id"], levels).withColumn("shown", F.coalesce("tampered", "digest"))
    m = folded(m.select("doc_id", "digest", "shown", "siblings", "path", "subroot", "root"), "shown")
    text = lambda c: F.lower(F.hex(c)).alias({"digest": "leaf", "folded": "folded_root"}.get(c, c))
    proof = F.sha2(F.lower(F.hex("siblings")), 256).alias("proof_sha256")
    return m.select("doc_id", text("digest"), text("subroot"), text("root"), proof, text("folded"), (F.col("folded") == F.col("root")).alias("verified"))


def _framed(text: str) -> str:
    cells = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in (*FIELDS[:-1], text)]
    return f"sha256({' || '.join(cells)})"


_CRC32 = """xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"""

OP12_SQL = f"""
WITH RECURSIVE
hashed AS (SELECT doc_id, lang, {_framed("text")} AS leaf,
    CASE WHEN {_CRC32} % 3 = 0 THEN {_framed(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} END AS tampered FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS rid, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes AS (
    SELECT lang, 0 AS lvl, pos, n, leaf AS digest FROM placed
    UNION ALL
    SELECT lang, lvl + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, lvl, pos // 8),
tops AS (SELECT lang, lvl, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
forest AS (
    SELECT 0 AS lvl, place AS pos, n, subroot AS digest FROM tops
    UNION ALL
    SELECT lvl + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM forest WHERE n > 1 GROUP BY lvl, pos // 8),
-- one numbering for both: forest nodes stand above each language's own levels
joined_levels AS (
    SELECT t.place, v.lvl, v.pos, v.digest FROM nodes v JOIN tops t ON t.lang IS NOT DISTINCT FROM v.lang WHERE v.n > 1
    UNION ALL
    SELECT t.place, t.lvl + f.lvl, f.pos, f.digest FROM forest f CROSS JOIN tops t WHERE f.n > 1),
around AS (
    SELECT place, lvl, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM joined_levels WINDOW w AS (PARTITION BY place, lvl, pos // 8 ORDER BY pos)),
steps AS (
    SELECT p.rid, t.place, t.lvl AS own, CASE WHEN t.lvl = 0 THEN t.place ELSE p.pos END AS at, 0 AS lvl, coalesce(p.tampered, p.leaf) AS digest, '' AS proof FROM placed p JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang
    UNION ALL
    SELECT s.rid, s.place, s.own, CASE WHEN s.lvl + 1 = s.own THEN s.place ELSE s.at // 8 END, s.lvl + 1, sha256(a.l || s.digest || a.r), s.proof || a.l || a.r
    FROM steps s JOIN around a ON a.place = s.place AND a.lvl = s.lvl AND a.pos = s.at),
ends AS (SELECT rid, digest AS folded_root, sha256(proof) AS proof_sha256 FROM steps QUALIFY row_number() OVER (PARTITION BY rid ORDER BY lvl DESC) = 1)
SELECT p.doc_id, p.leaf, t.subroot, f.digest AS root, e.proof_sha256, e.folded_root, e.folded_root = f.digest AS verified
FROM placed p JOIN ends e USING (rid) JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT digest FROM forest WHERE n = 1) f
"""
