"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the vectors by a random projection against a threshold, again and again; vectors within a margin of
the threshold go to both sides (spill), so a close pair is seldom parted in a tree and almost never in all ``TREES`` of
them. The margin is as wide as the distance of a pair at the least cosine along the projection, whatever the node holds.
Of some directions and thresholds the one with the fewest vectors in its margin is taken, so cuts pass beside groups;
where every margin holds ``CROWD`` of the vectors or more, the node is a group and stays whole. Thresholds come from a
sample of at most ``SAMPLE`` vectors; every vector is routed by them. Nodes are split down to about ``LEAF`` vectors, as
far as the sample supports it; larger leaves are compared in tiles of ``TILE`` vectors, all tile pairs, so their size is
no limit.

Within a leaf all pairs are compared by cosine in double precision. A pair that shares several leaves counts in the
first of them only, so links can be counted without listing pairs. From each leaf go, for every vector, the number of
its links and one edge to the smallest vector of its leaf-local component; the union of all leaves' edges gives the
components. Equal vectors are one, with their number, before anything is compared.

Vectors of each length have a forest of their own; those of different lengths have no cosine and no link.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing: no links,
a component of their own. Rows of equal vec_id are kept apart but share the id; a row without vec_id counts among the
links of others and has the component they have, but is never kept; a component of such rows alone has none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import materialize, n_partitions, with_columns_of
from specloom.llm.components import connected_components

COSINE = 0.9
TREES = 12
LEAF = 192
SAMPLE = 20_000
#: Directions and quantiles that a node tries for its threshold, on at most TRIAL of its vectors.
DIRECTIONS = 8
TRIAL = 512
CUTS = (0.25, 0.35, 0.45, 0.5, 0.55, 0.65, 0.75)
#: A node is not split if the best margin holds this share of it or more: its vectors are close to one another.
CROWD = 0.3
#: Sample vectors that a node needs to be split.
SUPPORT = 24
TILE = 1024


class Forest:
    """Trees of nodes (direction, low, high, left child, right child); a node that is not split is None, a leaf."""

    def __init__(self, sample: np.ndarray, count: int, trees: int = TREES, leaf: int = LEAF, cosine: float = COSINE, seed: int = 7):
        """``sample``: unit vectors; ``count``: vectors to be routed; ``cosine``: least cosine of pairs to be kept together."""
        rng = np.random.default_rng(seed)
        # along a standard normal direction two unit vectors of this cosine differ by so much, in standard deviations
        self.width = math.sqrt(max(0.0, 2 - 2 * cosine))
        self.trees = []
        for _ in range(trees):
            nodes: list[tuple[np.ndarray, float, float, int, int] | None] = [None]
            todo = [(0, np.arange(len(sample)))]
            while todo:
                k, rows = todo.pop()
                if len(rows) < SUPPORT or len(rows) * count <= leaf * len(sample):
                    continue
                cut = self._cut(sample[rows], rng)
                if cut is None:
                    continue
                direction, low, high = cut
                x = sample[rows] @ direction
                nodes[k] = (direction, low, high, len(nodes), len(nodes) + 1)
                todo += [(len(nodes), rows[x <= high]), (len(nodes) + 1, rows[x >= low])]
                nodes += [None, None]
            self.trees.append(nodes)

    def _cut(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float, float] | None:
        """The direction and margin that the fewest vectors fall in; none if every one lies in a crowd."""
        x = x if len(x) <= TRIAL else x[rng.choice(len(x), TRIAL, replace=False)]
        directions = rng.standard_normal((x.shape[1], DIRECTIONS))
        y = np.sort(x @ directions, axis=0)
        middle = y[[int(q * (len(x) - 1)) for q in CUTS]]
        best, out = CROWD * len(x), None
        for k in range(DIRECTIONS):
            low, high = middle[:, k] - self.width / 2, middle[:, k] + self.width / 2
            within = np.searchsorted(y[:, k], high, "right") - np.searchsorted(y[:, k], low, "left")
            at = int(np.argmin(within))
            if within[at] < best:
                best, out = within[at], (directions[:, k].copy(), float(low[at]), float(high[at]))
        return out

    def route(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each tree the (row, leaf) pairs of all rows of ``x``."""
        out = []
        for nodes in self.trees:
            rows, leaves = [], []
            todo = [(0, np.arange(len(x)))]
            while todo:
                k, r = todo.pop()
                split = nodes[k]
                if split is None:
                    rows.append(r)
                    leaves.append(np.full(len(r), k))
                    continue
                y = x[r] @ split[0]
                todo += [(child, r[pick]) for child, pick in ((split[3], y <= split[2]), (split[4], y >= split[1])) if pick.any()]
            row, node = np.concatenate(rows), np.concatenate(leaves)
            o = np.lexsort((node, row))
            out.append((row[o], node[o]))
        return out


def unit(values: pa.Array) -> np.ndarray:
    """Rows of a list column as double vectors of length one."""
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (vec_id, embedding, ok) and the classes of equal usable vectors (least, n, size, embedding)."""
    v = with_columns_of(vectors, "vec_id", "embedding")
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v = v.withColumn("norm", norm)
    # a null component makes the sum null, a non-finite one makes it non-finite
    fine = F.col("norm").isNotNull() & ~F.isnan("norm") & (F.col("norm") > 0) & (F.col("norm") < float("inf"))
    v = v.select("vec_id", "embedding", F.coalesce(fine, F.lit(False)).alias("ok"))
    groups = v.where("ok").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    return v, groups.select("least", "n", F.size("embedding").alias("size"), "embedding")


def _met_before(codes: pa.ListArray, rows: np.ndarray, leaf: int) -> np.ndarray:
    """Which pairs of ``rows`` share a leaf before this one: a square matrix. Leaves are ordered by their codes."""
    part = codes.take(pa.array(rows))
    values, owner = part.flatten().to_numpy(), np.repeat(np.arange(len(rows)), np.diff(part.offsets.to_numpy()))
    early = values < leaf
    _, column = np.unique(values[early], return_inverse=True)
    member = np.zeros((len(rows), int(column.max()) + 1 if len(column) else 1), np.float32)
    member[owner[early], column] = 1
    return member @ member.T > 0


def _compare(codes: pa.ListArray, ids: np.ndarray, n: np.ndarray, x: np.ndarray, side: np.ndarray, tiles: tuple[int, int], leaf: int, cosine: float):
    """Links first found in this leaf: for each row their number, and its smallest neighbour in the local component."""
    hit = x @ x.T >= cosine
    np.fill_diagonal(hit, False)
    if tiles[0] != tiles[1]:
        hit &= side[:, None] != side[None, :]
    rows = np.flatnonzero(hit.any(1))
    if not len(rows):
        return None
    new = hit[np.ix_(rows, rows)] & ~_met_before(codes, rows, leaf)
    i, j = np.nonzero(np.triu(new))
    i, j = rows[i], rows[j]
    if not len(i):
        return None
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, i, n[j])
    np.add.at(links, j, n[i])
    low = ids.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        if (before == low).all():
            break
    some = np.flatnonzero(links)
    return ids[some], links[some], low[some]


def link_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows, groups = classes(vectors)
    # the number of a class is fixed once the table is written
    groups = materialize(spark, groups.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    forests = {}
    for k, r in enumerate(groups.groupBy("size").count().orderBy("size").collect()):
        chosen = np.zeros((0, r["size"]))
        if r["count"] > LEAF:
            some = groups.where(F.col("size") == r["size"]).orderBy(F.xxhash64("least", "embedding")).limit(SAMPLE).select("embedding")
            chosen = unit(some.toArrow().column(0).combine_chunks())
        forests[r["size"]] = k, Forest(chosen, r["count"], trees, LEAF, cosine)
    frozen = spark.sparkContext.broadcast(forests)

    def route(batches):
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                b = big.slice(at, 2000)
                sizes = np.diff(b.column(2).offsets.to_numpy())
                codes: list[list[int]] = [[] for _ in range(b.num_rows)]
                for size in np.unique(sizes).tolist():
                    number, forest = frozen.value[size]
                    own = np.flatnonzero(sizes == size)
                    for t, (r, leaf) in enumerate(forest.route(unit(b.column(2).take(pa.array(own))))):
                        for i, k in zip(own[r].tolist(), leaf.tolist(), strict=True):
                            codes[i].append(number << 48 | t << 40 | k)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(codes, pa.list_(pa.int64()))], names=["rep", "n", "embedding", "codes"])

    routed = groups.select("rep", "n", "embedding").mapInArrow(route, f"rep bigint, n bigint, embedding {groups.schema['embedding'].dataType.simpleString()}, codes array<bigint>")
    routed = materialize(spark, routed, "routed")
    sizes = routed.select(F.explode("codes").alias("leaf")).groupBy("leaf").count().where("count > 1").select("leaf", F.ceil(F.col("count") / TILE).cast("int").alias("t"))
    placed = routed.select("rep", F.explode("codes").alias("leaf")).join(sizes, "leaf").withColumn("side", F.pmod(F.xxhash64("rep", "leaf"), "t").cast("int"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("t") - 1))).select("rep", "leaf", "side", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"))
    dealt = placed.join(routed, "rep").select("leaf", "i", "j", "rep", "n", "side", "embedding", "codes")
    dealt = dealt.repartition(n_partitions(spark), "leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def work(t: pa.Table):
            key = np.stack([t.column(c).to_numpy() for c in range(3)])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            ids, n, side = t.column(3).to_numpy(), t.column(4).to_numpy(), t.column(5).to_numpy()
            vectors, codes = (pa.concat_arrays(t.column(c).chunks) for c in (6, 7))
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), t.num_rows], strict=True):
                found = _compare(codes.slice(s, e - s), ids[s:e], n[s:e], unit(vectors.slice(s, e - s)), side[s:e], (int(key[1, s]), int(key[2, s])), int(key[0, s]), cosine)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "links", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch])
            key = np.stack([t.column(c).to_numpy() for c in range(3)])
            other = np.flatnonzero((key != key[:, -1:]).any(0))
            at = int(other[-1]) + 1 if len(other) else 0
            if at:
                yield from work(t.slice(0, at))
            held = t.slice(at).to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))

    found = materialize(spark, dealt.mapInArrow(compare, "a bigint, links bigint, b bigint"), "links")
    labels = connected_components(spark, found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    per_class = groups.select("rep", "least", "n", F.col("embedding").alias("v")).join(links, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.withColumn("label", F.coalesce("label", "rep"))
    component = per_class.groupBy("label").agg(F.min("least").alias("component"))
    per_class = per_class.join(component, "label")
    out = rows.join(per_class, rows["ok"] & (F.col("embedding") == F.col("v")), "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).cast("bigint").alias("n_links"), component.cast("bigint").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op10_vector_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
