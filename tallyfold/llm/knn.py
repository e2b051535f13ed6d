"""Exact top-k by inner product: a Voronoi kNN join.

A further component, sqrt(M - |v|^2) for data and 0 for queries, with M the largest squared norm, turns the
largest inner product into the smallest Euclidean distance. Pivots are rows of the data; queries are grouped
by their nearest pivot. A group's summary holds its radius around the pivot and how far its queries' k-th
nearest pivots are, which bounds how far their k-th neighbours can be. A vector goes only to groups that it
can be that near to: by its distance from the group's pivot less the radius, and by its distance from the
plane between that pivot and its own. Groups near each other are merged up to QUERY_GROUP queries, so a
vector is sent at most once for so many queries. Pairs of query groups and data chunks are solved locally,
and their best k are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import staged

MAX_PIVOTS = 1024  # sent to every task; their number decides how much is pruned, never what is found
QUERY_GROUP = 8192  # queries of a group
CHUNK = 32768  # vectors of a chunk
_SLACK = 1e-6  # bounds are widened by this share against rounding
_FOUND = "query_id long, vec_id long, score long"


def scaled(embedding: Column, by: int = 256) -> Column:
    """floor(by * x) of each component as double; null if the vector or a component is null or not finite."""
    v = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(embedding.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(x * by).cast("double")))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(len(column), -1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products with other rows.

    Components become floor(256 * x). Ties go to the smaller id; a query with fewer other vectors gets
    all. Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
    without an id. Vectors meet those of their own length. A row never meets rows of its own id; every row
    of a repeated id is a candidate, and rows of a repeated query id are answered together. Other columns
    are ignored; an empty table or one without queries gives no rows. `pivots` is by default the root of
    the number of rows, from 32 to 1,024.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), scaled(F.col(vector_col)).alias("v")).where("size(v) > 0")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2)
            ends = v.offsets.to_numpy()
            flat = v.values.to_numpy()[ends[0] : ends[-1]]
            size, ends = np.diff(ends), ends - ends[0]
            norms = np.add.reduceat(flat * flat, ends[:-1]) if len(flat) else np.zeros(0)
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(v), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size.astype(np.int32)), pa.array(norms), raw], names=["id", "q", "d", "norm", "v"])

    rows = staged(rows.mapInArrow(packed, "id long, q boolean, d int, norm double, v binary"), "vectors")
    found = spark.createDataFrame([], _FOUND)
    for d in rows.groupBy("d").agg(F.count("*").alias("n"), F.max("norm").alias("largest"), F.count_if("q").alias("asked")).orderBy("d").collect():  # one row per length of vectors
        if d["asked"]:
            found = found.union(_join(rows.where(F.col("d") == d["d"]), d["n"], d["largest"], k, pivots or max(32, min(MAX_PIVOTS, int(d["n"] ** 0.5)))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _chain(apart: np.ndarray) -> list[int]:
    """Cells in an order that keeps near ones together: each time the nearest cell not yet taken."""
    left, order = set(range(1, len(apart))), [0]
    while left:
        order.append(min(left, key=lambda c: (apart[order[-1], c], c)))
        left.remove(order[-1])
    return order


def _join(rows: DataFrame, n_rows: int, largest: float, k: int, pivots: int) -> DataFrame:
    """query_id, vec_id, score: of each query and chunk the k best, over rows of one length."""
    picked = rows.orderBy(F.xxhash64("id"), "id", "v").limit(pivots).select("id", "v").collect()
    pivot_ids, plain = np.array([r[0] for r in picked]), np.array([np.frombuffer(r[1]) for r in picked])
    lift = lambda m: np.c_[m, np.sqrt(np.maximum(largest - (m * m).sum(1), 0))]
    centres = lift(plain)
    squared = (centres * centres).sum(1)
    far_from = lambda x: np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + squared, 0))
    zero = lambda m: np.c_[m, np.zeros(len(m))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's cell, its distance from the pivot, and that of its k-th nearest pivot of another id."""
        for b in batches:
            d = far_from(zero(_matrix(b.column(1))))
            cell = d.argmin(1)
            far = d[np.arange(len(d)), cell]
            d[b.column(0).to_numpy()[:, None] == pivot_ids] = np.inf
            kth = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far), pa.array(kth)], names=["cell", "far", "kth"])

    asked = rows.where("q").select("id", "v")
    # Summaries of the query cells, one row for each pivot at most.
    cells = asked.mapInArrow(place, "cell int, far double, kth double").groupBy("cell").agg(F.max("far"), F.max("kth"), F.count("*")).orderBy("cell").collect()
    names = np.array([c[0] for c in cells])
    slack = _SLACK * (1 + largest**0.5)
    radius = np.array([c[1] for c in cells]) * (1 + _SLACK) + slack
    theta = np.array([c[2] for c in cells]) * (1 + _SLACK) + slack
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
    # Near cells share a group of up to QUERY_GROUP queries; larger cells are split over several groups.
    member = np.zeros((len(names), 0), bool)
    first, parts, filled = np.zeros(len(names), np.int64), np.ones(len(names), np.int64), QUERY_GROUP
    for c in _chain(apart[np.ix_(names, names)]):
        parts[c] = -(-cells[c][3] // QUERY_GROUP)
        if filled + cells[c][3] > QUERY_GROUP:
            member, filled = np.c_[member, np.zeros((len(names), parts[c]), bool)], 0
        filled += cells[c][3]
        first[c] = member.shape[1] - parts[c]
        member[c, first[c] :] = True
    groups, chunks = member.shape[1], max(1, -(-n_rows // CHUNK))
    at = np.full(len(centres), -1)
    at[names] = np.arange(len(names))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            c = at[far_from(zero(_matrix(b.column(1)))).argmin(1)]
            g = first[c] + (seen + np.arange(len(c))) % parts[c]
            seen += len(c)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(g.astype(np.int32))], names=["id", "v", "g"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() * 7919
        for b in batches:
            d = far_from(lift(_matrix(b.column(1))))
            own = d.argmin(1)
            near = d[np.arange(len(d)), own][:, None]
            gap = apart[own][:, names]
            plane = np.where(gap > 0, (d[:, names] ** 2 - near**2) / np.maximum(2 * gap, 1e-300), 0) * (1 - _SLACK) - slack
            need = (np.maximum(d[:, names] - radius, plane) <= theta) @ member
            row, group = np.nonzero(need)
            chunk = (seen + np.arange(len(d))) % chunks  # dealt in turn, so equal rows or ids fill no chunk
            seen += len(d)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(group.astype(np.int32)), pa.array(chunk[row].astype(np.int32))], names=["id", "v", "g", "c"])

    left = asked.mapInArrow(ask, "id long, v binary, g int").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = rows.select("id", "v").mapInArrow(send, "id long, v binary, g int, c int")
    # Whole numbers are exact in floats below these bounds, and a product never exceeds the largest squared norm.
    kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**52 else np.int64

    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = [[], [], []]
        if len(queries) and len(data):
            data = data.sort_values("id", kind="stable")
            ids, q_ids = data["id"].to_numpy(), queries["id"].to_numpy()
            m = np.frombuffer(b"".join(data["v"]), float).reshape(len(ids), -1).astype(kind).T
            a = np.frombuffer(b"".join(queries["v"]), float).reshape(len(q_ids), -1).astype(kind)
            for i in range(0, len(q_ids), 128):
                scores = a[i : i + 128] @ m
                for s, q in zip(scores, q_ids[i : i + 128].tolist(), strict=True):
                    lo, hi = np.searchsorted(ids, (q, q + 1))
                    if hi > lo:  # rows of the query's own id
                        s = np.r_[s[:lo], s[hi:]]
                    top = min(k, len(s))
                    if not top:
                        continue
                    floor = np.partition(s, len(s) - top)[len(s) - top]
                    best = np.flatnonzero(s >= floor)
                    best = best[np.argsort(-s[best], kind="stable")][:k]
                    out[0] += [q] * len(best)
                    out[1] += ids[np.where(best >= lo, best + hi - lo, best)].tolist()
                    out[2] += [int(x) for x in s[best]]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), out, strict=True))).astype("int64")

    return left.groupBy("g", "c").cogroup(right.groupBy("g", "c")).applyInPandas(solve, _FOUND)
