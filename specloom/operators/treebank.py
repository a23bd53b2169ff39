"""Constituency trees as arrays of nodes: each node an interval of preorder numbers.

A node covers the numbers pre..last, so containment, sisterhood and precedence are comparisons of numbers; words are
nodes too (leaves), as patterns name them. Only reading brackets is Python (Arrow batches); what follows is columns.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: pre, last: own and greatest number of the subtree; parent: -1 for the root; chain: nodes on the way down its left
#: edge; start, end: words (end exclusive); leaf: whether it is a word.
NODE = pa.struct([("pre", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("level", pa.int32()), ("chain", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("leaf", pa.bool_()), ("label", pa.string())])
NODE_SQL = "struct<pre:int,last:int,parent:int,level:int,chain:int,start:int,end:int,leaf:boolean,label:string>"

_PART = re.compile(r"\(|\)|[^\s()]+")


def read(text: str | None) -> list[dict]:
    """The nodes of the first bracketed tree in preorder; none where brackets do not match or a word stands outside."""
    nodes: list[dict] = []
    open_: list[int] = []
    words, want, done = 0, False, False

    def add(label: str, leaf: bool) -> None:
        nodes.append({"pre": len(nodes), "last": len(nodes), "parent": open_[-1] if open_ else -1, "level": len(open_), "chain": 0, "start": words, "end": words + leaf, "leaf": leaf, "label": label})

    for m in _PART.finditer(text or ""):
        part = m[0]
        if part == "(":
            if done:
                break
            add("", False)
            open_.append(len(nodes) - 1)
            want = True
        elif part == ")":
            if not open_:
                return []
            nodes[open_[-1]] |= {"last": len(nodes) - 1, "end": words}
            open_.pop()
            want, done = False, not open_
        elif not open_:
            if done:
                break
            return []
        elif want:
            nodes[open_[-1]]["label"], want = part, False
        else:
            add(part, True)
            words += 1
    if open_:
        return []
    for n in reversed(nodes):
        if n["last"] > n["pre"]:
            n["chain"] = nodes[n["pre"] + 1]["chain"] + 1
    return nodes


def read_nodes(trees: DataFrame, tree: str = "tree") -> DataFrame:
    """``trees`` with column nodes, an array of NODE in preorder (empty without a readable tree), in place of ``tree``."""
    rest = [c for c in trees.columns if c != tree]
    source = trees.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{tree}`"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([read(x.as_py()) for x in b.column(len(rest))], pa.list_(NODE))], names=[*rest, "nodes"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}nodes array<{NODE_SQL}>")


def node_table(trees: DataFrame, key: str = "req_id") -> DataFrame:
    """A row for each node: the key and the fields of NODE."""
    return read_nodes(trees.select(key, "tree")).select(key, F.inline("nodes"))


@F.udtf(returnType="pre int, last int, parent int, level int, chain int, start int, end int, leaf boolean, label string")
class TreeNodes:
    """SQL: ``FROM trees t, LATERAL tree_nodes(t.tree)`` gives a row for each node of a tree, none where it cannot be read."""

    def eval(self, tree: str):
        for n in read(tree):
            yield tuple(n[f.name] for f in NODE)


def register(spark) -> None:
    """Make the table function tree_nodes known to the session's SQL."""
    spark.udtf.register("tree_nodes", TreeNodes)
