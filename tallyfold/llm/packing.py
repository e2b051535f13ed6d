"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

Documents are dealt by row number into shards of bounded size, and each shard is packed by itself: longest
first, every piece into the open bin with the least room that holds it and whose source and duplicate
cluster bitmaps are free of the piece's bits; the successor search goes on until such a bin is found.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import staged, whole_groups

CAPACITY = 2048  # in the unit of the sizes given
SHARD_ROWS = 4096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, pieces in the given order; no bin gets a source or a cluster twice.

    Open bins stand in a list ordered by (room, bin). A negative source or cluster conflicts with nothing.
    """
    open_bins: list[tuple[int, int]] = []
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 1 << source if source >= 0 else 0, 1 << cluster if cluster >= 0 else 0
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (source_bits[open_bins[at][1]] & s or cluster_bits[open_bins[at][1]] & c):
            at += 1
        if at < len(open_bins):
            room, k = open_bins.pop(at)
        else:
            room, k = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[k] |= s
        cluster_bits[k] |= c
        out.append((k, capacity - room))
        if room > size:
            insort(open_bins, (room - size, k))
    return out


def pack(docs: DataFrame, size: Column, cluster: Column, id_col: str = "doc_id", source_col: str = "source", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, shards: int | None = None) -> DataFrame:
    """doc_id, piece, size, shard, bin, bin_offset, bin_used of every piece of every row.

    `size` is a row's length in the unit of `capacity` (tokens, or words as in the registered query; an
    encoder's counts make bins that fit a model's sequences). Longer rows than `capacity` are cut: each full
    piece fills a bin of its own, and the rest is packed like any row. Within a bin no two pieces share a
    source, and none share a duplicate cluster; null sources and clusters conflict with nothing. Rows of
    size 0 or null have one piece of size 0 and no bin. Rows are packed longest first, then by id, source
    and cluster; repeated rows are packed as often as they come; an empty table gives no rows; other columns
    are ignored. Bins are numbered within their shard; `shard` is part of the key.

    Rows are dealt into `shards` (by default one for each `shard_rows` rows) by the hash of a row number
    that is written with them: equal rows fill no shard, and a lost task deals its rows as before. The
    numbers follow the input's files and partitions, so another layout of a table gives other bins of the
    same kind. Give `shards` to keep their number while a table grows; 1 packs all rows together, in one
    task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(source_col)).alias("source"), F.col(source_col).isNull().alias("no_source"), cluster.cast("long").alias("cluster"), F.coalesce(size.cast("long"), F.lit(0)).alias("n"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "sizes")
    shards = shards or max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "shard"):
            for shard in dict.fromkeys(t["shard"].to_pylist()):
                g = t.filter(pa.compute.equal(t["shard"], shard)).sort_by([("n", "descending"), ("doc_id", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
                yield from one(shard, g)

    def one(shard: int, g: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, n = g["doc_id"].to_pylist(), g["n"].to_pylist()
        seen: dict[int, int] = {}
        source = [-1 if x else seen.setdefault(s, len(seen)) for s, x in zip(g["source"].to_pylist(), g["no_source"].to_pylist(), strict=True)]
        groups: dict[int, int] = {}
        cluster = [-1 if c is None else groups.setdefault(c, len(groups)) for c in g["cluster"].to_pylist()]
        rows, pieces = [], []
        for i, size in enumerate(n):
            full = size // capacity
            rows += [(doc[i], p, capacity, None, 0, capacity) for p in range(full)]
            if size == 0:
                rows.append((doc[i], 0, 0, None, None, None))
            elif size % capacity:
                pieces.append((size % capacity, i, full))
        pieces.sort(key=lambda p: -p[0])
        placed = best_fit([p[0] for p in pieces], [source[p[1]] for p in pieces], [cluster[p[1]] for p in pieces], capacity)
        used = np.zeros(1 + max((b for b, _ in placed), default=-1), np.int64)
        for (size, _, _), (b, _) in zip(pieces, placed, strict=True):
            used[b] += size
        rows += [(doc[i], p, size, b, offset, int(used[b])) for (size, i, p), (b, offset) in zip(pieces, placed, strict=True)]
        free = len(used)
        out = []
        for doc_id, p, size, b, offset, total in rows:
            if b is None and size:
                b, free = free, free + 1
            out.append((doc_id, p, size, shard, b, offset, total))
        columns = list(zip(*out, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "piece", "size", "shard", "bin", "bin_offset", "bin_used"])

    dealt = rows.select("shard", "doc_id", "source", "no_source", "cluster", "n").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(fit, "doc_id long, piece long, size long, shard long, bin long, bin_offset long, bin_used long")


def count_words(text: Column) -> Column:
    """Words parted by white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def same_text(text: Column) -> Column:
    """Duplicate cluster of a text: its hash without case and white space differences; null for texts without words."""
    words = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(F.length(words) > 0, F.xxhash64(words))
