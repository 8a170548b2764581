"""Merkle manifest of a dataset: digests, and for each leaf the path that proves it.

A tree over each group's rows in order, and one over the groups' roots; a node is the digest of a run of up to RUN nodes. Leaves are dealt
into aligned blocks of RUN ** HEIGHT, which are whole subtrees. Roots of blocks are made by a treehash stack, and are the leaves of the
next pass, until each tree has one node. Then paths are made from the top down: in a block they are advanced leaf by leaf, as in Merkle
tree traversal, and what lies above the block, which all of its leaves share, is appended.

A block's traversal keeps at each height the run that the leaf is under, and a stack that builds the next run of that height by one leaf
a step, so that it is ready when the leaf gets there: no more than (2 RUN - 1) * HEIGHT nodes and the stacks of HEIGHT treehashes, each
with fewer than RUN nodes a level. Besides them a task holds a block's own digests. Only digests are shuffled, never texts, and no task
gets more than some blocks, however many rows a group has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import delete, written

RUN, HEIGHT = 3, 6
BLOCK = RUN**HEIGHT
PATH = "array<struct<left:string,right:string>>"


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Treehash:
    """Builds the nodes of a height over leaves from `at` to `stop`, a leaf a step."""

    def __init__(self, leaves: Sequence[str], height: int, at: int, stop: int):
        self.leaves, self.height, self.at, self.stop = leaves, height, at, min(stop, len(leaves))
        self.stack: list[list[str]] = [[] for _ in range(height)]
        self.nodes: list[str] = []

    def step(self) -> None:
        if self.at < self.stop:
            self._push(0, self.leaves[self.at])
            self.at += 1
            if self.at == len(self.leaves):  # runs that are short at the end of the leaves
                for level in range(self.height):
                    if self.stack[level]:
                        self._raise(level)

    def all(self) -> list[str]:
        while self.at < self.stop:
            self.step()
        return self.nodes

    def _push(self, level: int, node: str) -> None:
        if level == self.height:
            self.nodes.append(node)
            return
        self.stack[level].append(node)
        if len(self.stack[level]) == RUN:
            self._raise(level)

    def _raise(self, level: int) -> None:
        run, self.stack[level] = self.stack[level], []
        self._push(level + 1, digest(run))


def height_of(size: int) -> int:
    """Levels that a tree's block has: all of them where the tree has several blocks, else as many as leave one node."""
    height = 0
    while height < HEIGHT and RUN**height < size:
        height += 1
    return height


def traverse(leaves: Sequence[str], height: int) -> Iterator[list[dict[str, str]]]:
    """Of each leaf in turn, the other nodes of the runs it is under, from the leaf up to `height`, as text left and right of its own node."""
    span = [RUN**h for h in range(height + 1)]
    runs = [Treehash(leaves, h, 0, span[h + 1]).all() for h in range(height)]
    soon = [Treehash(leaves, h, span[h + 1], 2 * span[h + 1]) for h in range(height)]
    for i in range(len(leaves)):
        path = []
        for h, run in enumerate(runs):
            own = i // span[h] % RUN
            path.append({"left": "".join(run[:own]), "right": "".join(run[own + 1 :])})
        yield path
        for h in range(height):
            soon[h].step()
            if (i + 1) % span[h + 1] == 0:
                runs[h] = soon[h].nodes
                soon[h] = Treehash(leaves, h, i + 1 + span[h + 1], i + 1 + 2 * span[h + 1])


def _in_order(nodes: DataFrame, order: Sequence[str]) -> tuple[DataFrame, str]:
    """`pos` of each node in its tree, and its tree's `size`: by ranges of all nodes and sums of what comes before, without a task of a whole tree."""
    placed, path = written(nodes.repartitionByRange("_tree", *order, "_node").sortWithinPartitions("_tree", *order, "_node").withColumn("_at", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    runs = placed.groupBy("_tree", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("_tree")  # a row for each range of a tree
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_tree", "_range", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("_size"))
    out = placed.join(runs, ["_tree", "_range"]).withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")
    out, at = written(out, "nodes")
    delete(nodes.sparkSession, path)
    return out, at


def _roots(nodes: DataFrame) -> DataFrame:
    """The nodes HEIGHT levels up: one of each block of each tree."""

    def root(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_pos")
        leaves, size = rows["_node"].to_pylist(), rows["_size"][0].as_py()
        node = Treehash(leaves, height_of(size), 0, len(leaves)).all()[0]
        return pa.table({"_tree": rows["_tree"][:1], "_pos": [key[1].as_py()], "_node": [node], "_size": [-(-size // BLOCK)]})

    blocks = nodes.select("_tree", F.col("_pos").alias("_pos"), "_node", "_size", F.floor(F.col("_pos") / BLOCK).alias("_block"))
    return blocks.groupBy("_tree", "_block").applyInArrow(root, "_tree string, _pos bigint, _node string, _size bigint")


def _down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """`nodes` with `path` up to the last root, `subroot` and `root`; `above` has those of each block."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    kinds |= {"path": PATH, "subroot": "string", "root": "string"}
    path_type = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def paths(rows: pa.Table, top: pa.Table) -> pa.Table:
        rows, upper = rows.sort_by("_pos").drop_columns(["_block"]), top["path"][0].as_py() if len(top) else []
        found = [own + upper for own in traverse(rows["_node"].to_pylist(), height_of(rows["_size"][0].as_py() if len(rows) else 0))]
        rows = rows.append_column("path", pa.array(found, path_type))
        for c in ("subroot", "root"):
            rows = rows.append_column(c, pa.array([top[c][0].as_py()] * len(rows), pa.string()))
        return rows

    blocks = nodes.withColumn("_block", F.floor(F.col("_pos") / BLOCK)).groupBy("_tree", "_block")
    return blocks.cogroup(above.withColumnRenamed("_pos", "_block").groupBy("_tree", "_block")).applyInArrow(paths, ", ".join(f"`{n}` {k}" for n, k in kinds.items()))


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], list[str]]:
    """Nodes in order, the roots of their blocks, those of theirs and so on, to one node a tree; and the tables that hold them."""
    passes, tables = [nodes], []
    while True:
        level, path = written(_roots(passes[-1]), "roots")
        passes.append(level)
        tables.append(path)
        if (level.agg(F.max("_size")).first()[0] or 0) <= 1:
            return passes, tables


def _descend(passes: list[DataFrame], over: DataFrame | None = None) -> DataFrame:
    """The first of the passes with paths. `over` has, for each tree, the path of its root in a tree above it and that one's root."""
    top = passes[-1].select("_tree", "_pos", F.col("_node").alias("subroot"))
    if over is None:
        above = top.select("_tree", "_pos", F.array().cast(PATH).alias("path"), "subroot", F.col("subroot").alias("root"))
    else:
        above = top.join(over, "_tree").select("_tree", "_pos", "path", "subroot", "root")
    for level in passes[-2:0:-1]:
        above = _down(level, above).select("_tree", "_pos", "path", "subroot", "root")
    return _down(passes[0], above)


def leaf(*fields: Column) -> Column:
    """Digest of a row: of each field its length in bytes, a colon and its text, or `-` if it is null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def fold(path: Column, node: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, node, lambda own, run: F.sha2(F.concat(run["left"], own, run["right"]), 256))


def siblings(path: Column) -> Column:
    """The nodes of a path as one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), "")


def manifest(rows: DataFrame, node: Column, group: Column, order: Sequence[Column], keep: dict[str, Column]) -> DataFrame:
    """The columns of `keep`, and leaf, path (array of left and right siblings, from the leaf to the root), subroot (of its group), root.

    Groups are compared as text by bytes, null first and a group of its own; rows of a group by `order`, null first, then by their leaf:
    rows that are equal in all of these may change places, which changes no digest. A row that is repeated is a leaf each time. An empty
    table gives an empty manifest. Only the columns named are read. The result reads tables in the shared folder until it is written.
    """
    own = {f"_k{i}": c.alias(f"_k{i}") for i, c in enumerate(keep.values())}
    by = {f"_o{i}": c.alias(f"_o{i}") for i, c in enumerate(order)}
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    nodes, _ = _in_order(rows.select(tree.alias("_tree"), node.alias("_node"), *by.values(), *own.values()), list(by))
    nodes = nodes.drop(*by)
    passes, _ = _climb(nodes)
    groups, _ = _in_order(passes[-1].select(F.lit("").alias("_tree"), "_node", F.col("_tree").alias("_group")), ["_group"])
    above, _ = _climb(groups)
    over, _ = written(_descend(above).select(F.col("_group").alias("_tree"), "path", "root"), "groups")
    out = _descend(passes, over)
    return out.select(*(F.col(a).alias(b) for a, b in zip(own, keep)), F.col("_node").alias("leaf"), "path", "subroot", "root")
