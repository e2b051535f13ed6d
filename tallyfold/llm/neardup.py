"""Near-duplicate documents by b-bit MinHash, confirmed on whole shingle sets.

1. Every text becomes a set of hashed word shingles, a fingerprint of that set, 256 minima, band hashes
   of the minima and their low two bits packed into 64 bytes. Texts with equal sets form one class.
2. Class representatives that share a band bucket are candidates. In each bucket, packed signatures are
   compared by bit counts; the estimate is corrected for chance collisions of two-bit values. A search
   from member to member keeps a spanning forest of pairs over the estimate, never all pairs.
3. Components of these candidate pairs are clusters. The members' texts are brought together once per
   cluster (large clusters in pairs of blocks), and links are confirmed on full sets with the exact rule
   100 * |A & B| >= 80 * |A | B|; again only a spanning forest of links is returned.
4. Components of the links give each class, and so each document, its component.

Nothing is capped: buckets and clusters over a block's size are split into pairs of blocks, so that every
two members meet. The chance that a pair at the threshold shares no band is (1 - 0.8**6)**42, 3e-6; that
its estimate falls five deviations short, below 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import components, staged, to_bytes, whole_groups

HASHES, ROWS, BANDS, BITS = 256, 6, 42, 2
BUCKET_BLOCK = 4096  # members of a bucket compared in one piece
CLUSTER_BLOCK = 500_000  # shingles of a cluster confirmed in one piece
BROADCAST_ROWS = 500_000  # of 16 bytes; more candidate ids than this are joined by a shuffle

_MASK = np.uint64(0x5555555555555555)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Distinct hashed shingles of whole texts: A-Z lower-cased, words parted by ASCII white space."""

    def __init__(self, width: int):
        self.width, self.known = width, {}
        self.odd = _mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        known = self.known
        try:
            ids = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > 500_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            ids = np.array([known[w] for w in words], np.uint64)
        if not len(ids):
            return ids
        width = min(self.width, len(ids))
        n = len(ids) - width + 1
        total = np.full(n, len(ids) if width < self.width else 0, np.uint64)  # a short text is one shingle of its own
        for k in range(width):
            total += _mix(ids[k : k + n] + self.odd[k]) * self.odd[k]
        return np.unique(_mix(total))


class Signer:
    """256 minima of a shingle set, from multiplicative permutations of 32-bit values."""

    def __init__(self) -> None:
        seeds = _mix(np.arange(1000, 1000 + 3 * HASHES, dtype=np.uint64)).astype(np.uint32)
        self.a, self.b, self.c = (seeds[i::3][:, None] for i in range(3))
        self.a, self.c = self.a | np.uint32(1), self.c | np.uint32(1)
        self.odd = _mix(np.arange(5000, 5000 + ROWS, dtype=np.uint64)) | np.uint64(1)
        self.band = _mix(np.arange(9000, 9000 + BANDS, dtype=np.uint64))

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 1024):
            h = x[None, i : i + 1024] * self.a
            h += self.b
            h ^= h >> np.uint32(15)
            h *= self.c
            np.minimum(low, h.min(axis=1), out=low)
        rows = low[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64)
        bands = _mix((_mix(rows + self.odd) * self.odd).sum(axis=1, dtype=np.uint64) + self.band)
        two = ((low >> np.uint32(16)) & np.uint32(3)).astype(np.uint64).reshape(8, 32)
        packed = (two << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64)
        return bands.view(np.int64), packed


_SIGNED = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, packed binary"


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, bands, packed) of each row; all but the count are null for empty sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, signer = Shingler(width), Signer()
        for batch in batches:
            counts, first, second, bands, packed = [], [], [], [], []
            for text in to_bytes(batch.column(1)):
                s = shingles(text)
                counts.append(len(s))
                if not len(s):
                    for out in (first, second, bands, packed):
                        out.append(None)
                    continue
                digest = xxhash.xxh3_128_digest(s.tobytes())
                first.append(int.from_bytes(digest[:8], "little", signed=True))
                second.append(int.from_bytes(digest[8:], "little", signed=True))
                b, p = signer(s)
                bands.append(b)
                packed.append(p.tobytes())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "fp1", "fp2", "bands", "packed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(sign, _SIGNED)


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures by bit counts, corrected for the 1 in 4 chance collisions."""
    d = x ^ y
    unequal = np.bitwise_count((d | (d >> np.uint64(1))) & _MASK).sum(axis=-1, dtype=np.int64)
    chance = 0.5**BITS
    return (1 - unequal / HASHES - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """Five standard deviations of the estimate below the threshold."""
    chance = 0.5**BITS
    p = threshold + (1 - threshold) * chance
    return threshold - 5 * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def _spans(key: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(key)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True))


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_EDGE)


def _bucket_pairs(least: float):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "g"):
            key, rep = t["g"].to_numpy(), t["rep"].to_numpy()
            packed = np.frombuffer(b"".join(t["packed"].to_pylist()), np.uint64).reshape(-1, 8)
            left, right = [], []
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            for size in np.unique(sizes[(sizes > 1) & (sizes <= 12)]).tolist():
                i, j = np.triu_indices(size, 1)
                at = starts[sizes == size]
                left.append((at[:, None] + i).ravel())
                right.append((at[:, None] + j).ravel())
            if left:
                i, j = np.concatenate(left), np.concatenate(right)
                ok = (estimate(packed[i], packed[j]) >= least) & (rep[i] != rep[j])
                if ok.any():
                    yield _edges(rep[i[ok]], rep[j[ok]])
            for at, size in zip(starts[sizes > 12].tolist(), sizes[sizes > 12].tolist(), strict=True):
                rest, queue, found = np.arange(at, at + size), [], []
                while len(rest):
                    now = queue.pop() if queue else int(rest[0])
                    rest = rest[rest != now]
                    ok = estimate(packed[rest], packed[now]) >= least
                    hits = rest[ok].tolist()
                    found += [(now, x) for x in hits]
                    queue += hits
                    rest = rest[~ok]
                if found:
                    i, j = np.array(found).T
                    ok = rep[i] != rep[j]
                    yield _edges(rep[i[ok]], rep[j[ok]])

    return pairs


def _search(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span each linked part of `sets`: every member reached is compared with those not yet reached."""
    size = np.array([len(s) for s in sets])
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends, has, alive = np.cumsum(size), np.zeros(len(words), bool), size > 0
    kept, found, queue = np.array([], int), [], []
    index = starts = kept
    while alive.any():
        now = queue.pop() if queue else int(alive.argmax())
        alive[now] = False
        left = int(alive.sum())
        if not left:
            break
        if not len(kept) or 2 * left < len(kept):  # leave out the shingles of members already reached
            kept = np.flatnonzero(alive)
            index = flat[np.concatenate([np.arange(ends[i] - size[i], ends[i]) for i in kept])]
            starts = np.r_[0, np.cumsum(size[kept])[:-1]]
        own = flat[ends[now] - size[now] : ends[now]]
        has[own] = True
        both = np.add.reduceat(has[index], starts, dtype=np.int64)
        has[own] = False
        hits = kept[alive[kept] & (100 * both >= percent * (size[kept] + size[now] - both))].tolist()
        alive[hits] = False
        found += [(now, x) for x in hits]
        queue += hits
    return found


def _links(width: int, percent: int):
    """Spanning forest of the links within each group, by searches over exact intersection counts."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for t in whole_groups(batches, "g"):
            rep, texts = t["rep"].to_numpy(), to_bytes(t["text"])
            found: list[tuple[int, int]] = []
            for lo, hi in _spans(t["g"].to_numpy()):
                sets = [shingles(x) for x in texts[lo:hi]]
                if len(sets) == 2:
                    both = len(np.intersect1d(*sets, assume_unique=True))
                    if 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both) > 0:
                        found.append((lo, lo + 1))
                    continue
                found += [(lo + x, lo + y) for x, y in _search(sets, percent)]
            if found:
                i, j = np.array(found).T
                ok = rep[i] != rep[j]
                yield _edges(rep[i[ok]], rep[j[ok]])

    return links


def _block_of(rep: str) -> Column:
    """A member's block of its group: blocks are dealt by hash, so no task sorts or numbers a whole group."""
    return F.expr(f"pmod(xxhash64({rep}), last_blk + 1)").alias("blk")


def _in_block_pairs(rows: DataFrame, key: str) -> DataFrame:
    """One row per pair of blocks that a row belongs to; `g` names the pair. Needs columns blk and last_blk."""
    to = F.explode(F.expr("sequence(0L, last_blk)")).alias("other")
    return rows.select("*", to).withColumn("g", F.expr(f"xxhash64({key}, least(blk, other), greatest(blk, other))")).drop("other", "blk", "last_blk")


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("g").sortWithinPartitions("g")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept for every row of `docs`.

    Two rows are linked if 100 * |A & B| >= percent * |A | B| for their shingle sets (percent from 50 to
    100); class_id is the smallest id with the same set, component_id the smallest id reachable by links.
    kept is doc_id = component_id. Texts that are null, empty or only white space have an empty set: such
    a row is linked with nothing and kept. A row without an id keeps null ids and is kept. Repeated rows
    fall into one class and come back as often as they came in. Columns besides id and text are ignored.
    """
    signed = staged(signatures(docs, width, id_col, text_col), "signed")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    classes = staged(real.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep")), "classes")
    own = real.join(classes.withColumnRenamed("rep", "doc_id"), ["fp1", "fp2", "doc_id"], "left_semi")
    reps = own.dropDuplicates(["fp1", "fp2", "doc_id"]).select(F.col("doc_id").alias("rep"), "n_shingles", "packed", "bands")
    reps = staged(reps, "reps")
    banded = reps.select("rep", F.explode("bands").alias("bh"))
    buckets = banded.groupBy("bh").agg(F.count("*").alias("n")).where("n > 1").select("bh", F.expr(f"(n - 1) div {BUCKET_BLOCK}").alias("last_blk"))
    members = banded.join(buckets, "bh").select("bh", "rep", _block_of("rep"), "last_blk")  # AQE splits a hot bucket
    members = _in_block_pairs(members, "bh").drop("bh").join(reps.select("rep", "packed"), "rep")
    pairs = _together(members.select("g", "rep", "packed")).mapInArrow(_bucket_pairs(least_estimate(percent / 100)), "a long, b long")
    clusters = components(pairs, "clusters")
    clusters = clusters.union(clusters.select("root", "root").distinct()).toDF("rep", "cluster")
    placed = staged(clusters.join(reps.select("rep", "n_shingles"), "rep"), "members")
    large = placed.groupBy("cluster").agg(F.expr(f"(sum(n_shingles) - 1) div {CLUSTER_BLOCK}").alias("last_blk")).where("last_blk > 0")
    large = staged(large, "large")
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    placed = placed.join(large, "cluster", "left").withColumn("last_blk", F.coalesce("last_blk", F.lit(0))).withColumn("blk", _block_of("rep"))
    placed = staged(_in_block_pairs(placed.select("cluster", "rep", "blk", "last_blk"), "cluster").select("g", F.col("rep").alias("doc_id")), "placed")
    few = placed.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    met = texts.join(F.broadcast(placed) if few else placed, "doc_id").select("g", F.col("doc_id").alias("rep"), "text")
    links = components(_together(met).mapInArrow(_links(width, percent), "a long, b long"), "links")
    roots = classes.join(links.select(F.col("node").alias("rep"), "root"), "rep", "left")
    roots = roots.select("fp1", "fp2", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("root"))
    out = signed.select("doc_id", "n_shingles", "fp1", "fp2").join(roots, ["fp1", "fp2"], "left")
    named = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
    component = named("root")
    return out.select("doc_id", "n_shingles", named("class_id").alias("class_id"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
