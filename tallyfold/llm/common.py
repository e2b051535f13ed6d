"""What the operators of this subpackage share: staged tables, streams of whole groups, components."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.sources.shared import shared_dir, staged  # noqa: F401

# Workers receive these functions by value, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules["tallyfold.llm"])

EDGES = 1 << 19  # edges shrunk in one piece


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup a stream sorted by `key` so that no group is split over two tables.

    Callers bound the rows of a group beforehand (blocks), so what is held stays bounded.
    """
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        last = keys[-1]
        start = len(keys) - int((keys[::-1] != last).argmax()) if (keys != last).any() else 0
        if start or (held and held_key != last):
            head = [*held, batch.slice(0, start)] if start else held
            yield pa.Table.from_batches(head)
            held = []
        held.append(batch.slice(start))
        held_key = last
    if held:
        yield pa.Table.from_batches(held)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node reachable) of the given edges; union-find over one task's edges."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        path = []
        while (p := parent.setdefault(x, x)) != x:
            path.append(x)
            x = p
        for y in path:
            parent[y] = x
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx < ry:
            parent[ry] = rx
        elif ry < rx:
            parent[rx] = ry
    nodes = [x for x in parent if root(x) != x]
    return np.array([root(x) for x in nodes], "int64"), np.array(nodes, "int64")


def _forest_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run of about EDGES edges becomes its forest; what is held is bounded by the run."""
    held: list[pa.RecordBatch] = []

    def shrunk() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        a, b = forest(t["a"].to_numpy(), t["b"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= EDGES:
            yield shrunk()
            held = []
    if held:
        yield shrunk()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root) for every node of an edge.

    `root` is the smallest node reachable; nodes that are their own root are left out. Each task first
    shrinks its edges to a forest; then large-star and small-star steps alternate, each one a grouped
    minimum and a join, until the edges stop changing. Every round is written to the shared folder. A
    node's edges are joined with its one minimum; adaptive execution splits a hub's side where it is large.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = staged(e.mapInArrow(_forest_of_task, "a long, b long").distinct(), name)
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))")).first()
        if mark == seen:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = mark
        large = _least(e.union(e.select("b", "a")).toDF("u", "v")).where("v > u").select(F.least("u", "m").alias("a"), F.col("v").alias("b")).distinct()
        small = _least(large.where("a < b").select(F.col("b").alias("u"), F.col("a").alias("v"))).select(F.expr("inline(array(struct(m as a, v as b), struct(m as a, u as b)))"))
        e = staged(small.where("a < b").distinct(), name)


def _least(edges: DataFrame) -> DataFrame:
    """u, v, m: each edge with the smallest neighbour of u."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def to_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
