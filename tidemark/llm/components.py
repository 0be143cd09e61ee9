"""Connected components of an edge list that may be larger than any one task's memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: So many edges at most are finished in one task (16 bytes each); more are contracted first.
ONE_TASK_EDGES = 1_000_000


def union(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number in each of 0..n-1's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
    return root


def _labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    return nodes, nodes[union(index[: len(a)], index[len(a) :], len(nodes))] if len(nodes) else nodes


def forest(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: each partition keeps node-to-root edges only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        held: list[pa.RecordBatch] = []
        rows = 0

        def reduced() -> tuple[np.ndarray, np.ndarray]:
            nodes, roots = _labels(np.concatenate([a, *(x.column(0).to_numpy() for x in held)]), np.concatenate([b, *(x.column(1).to_numpy() for x in held)]))
            return nodes[nodes != roots], roots[nodes != roots]

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ONE_TASK_EDGES:
                a, b = reduced()
                held, rows = [], 0
                if len(a) >= ONE_TASK_EDGES:  # too many nodes for one look: pass them on
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = reduced()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """``node, root`` for every node of an edge list ``a, b``: root is its component's smallest.

    While there are many edges, each round hooks every node to its smallest neighbour, follows
    the hooks to their ends and puts these ends in the edges' place, which at least halves the
    nodes that still have edges; a bounded rest is finished in one task.
    """
    left = cut(forest(edges).filter("a <> b").distinct())
    maps: DataFrame | None = None
    while left.count() > one_task:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = cut(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("root")))
        while True:  # hooks only lead to smaller nodes, so they end
            up = hooks.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            jumped = cut(hooks.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"), (F.coalesce("_r", "root") != F.col("root")).alias("_moved")))
            hooks = jumped.select("node", "root")
            if jumped.filter("_moved").isEmpty():
                break
        to = hooks.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        maps = hooks if maps is None else cut(_follow(maps, to))
        ends = left.join(to, F.col("a") == F.col("_n")).select(F.col("_r").alias("a"), "b").join(to, F.col("b") == F.col("_n")).select("a", F.col("_r").alias("b"))
        left = cut(forest(ends.filter("a <> b")).distinct())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            nodes, roots = _labels(np.concatenate([x.column(0).to_numpy() for x in held]), np.concatenate([x.column(1).to_numpy() for x in held]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])

    rest = left.coalesce(1).mapInArrow(finish, "node long, root long")
    if maps is None:
        return rest
    to = cut(rest).select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return _follow(maps, to)


def _follow(maps: DataFrame, to: DataFrame) -> DataFrame:
    return maps.join(to, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
