"""Hierarchical Pitman-Yor language model of word pairs, and the log probability of every text under it.

A word's predecessor names its restaurant; all restaurants share the unigram restaurant as parent, and that
one the uniform base. Customers are the training tokens, a dish is a word; each table of a restaurant is a
customer of its parent. Seats are sampled by Gibbs, sweep by sweep: all restaurants given the parent of the
sweep before, then the parent given their tables. A restaurant's predictive probability is

    P(w | u) = (c_uw - d t_uw + (theta + d t_u) P(w)) / (theta + c_u)

and scores are averages of it over the kept sweeps.

How the work is dealt. Words are known by 48-bit hashes. Documents are read once, in chunks of about
CHUNK tokens, and of a chunk only its distinct pairs are shuffled. A pair (u, w) belongs to the block
(hash u mod g, hash w mod g); so a frequent word's restaurant is shared out over g blocks, and so are a
frequent dish's customers. A block counts its pairs over all chunks and seats them. What it knows of words is
summed in slices: one for each value of hash mod g, for words as restaurants and as dishes. Blocks tell slices
their tables, slices answer with the totals of the block's own words. At last each block answers every chunk
with the log probabilities of the pairs that it asked for, and a chunk adds them up by document. All tables
are counted over all training texts; g grows with their size, and nothing whole passes through the driver.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import shared_dir, to_bytes, whole_groups

CHUNK = 1_500_000  # tokens whose distinct pairs are asked for together; a longer text is one chunk
BLOCK_CHARS = 10_000_000  # of text for each block of pairs
BURN, KEPT = 1, 2  # sweeps before, and sweeps averaged over
STRENGTH, PARENT_STRENGTH = 1.0, 10.0
SCANS = 2  # Gibbs scans over a restaurant's customers in a sweep
LARGE = 64  # a dish with more customers is seated in growing groups, not one by one
END = b"\n"  # ends a text and stands before its first word; no word holds white space
_MASK = np.uint64((1 << 48) - 1)


def pack(a: np.ndarray, rising: bool = False) -> bytes:
    """An array's bytes, place by place, compressed; rising ones by their steps."""
    if rising and len(a):
        a = np.r_[a[:1], np.diff(a)]
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 3)


def unpack(b: bytes, kind: type, rising: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    a = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T
    a = np.ascontiguousarray(a).view(kind).ravel()
    return np.cumsum(a, dtype=kind) if rising else a


def _batch(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_ENCODED = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("block", pa.int32())] + [(n, pa.binary()) for n in ("ids", "sizes", "at", "flags", "ws", "per_w", "us", "ui", "n")])
_ENCODED_SQL = "kind string, chunk long, block int, ids binary, sizes binary, at binary, flags binary, ws binary, per_w binary, us binary, ui binary, n binary"


def encode(docs: DataFrame, learn: Column, g: int, id_col: str, text_col: str) -> DataFrame:
    """For each chunk a row of its documents (block -1) and one for each block that it asks.

    Documents: ids, tokens (with the end), for every token the place of its pair in what the chunk asks, flags
    (1 learned from, 2 no id). Asked: the distinct second words (ws), how many pairs each has, the distinct
    first words (us), each pair's place there, its training count; pairs stand by (w, u).
    """

    def encode_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        known, ids, learned, cur, held = numbers(), [], [], [], 0
        for b in (x.slice(at, 256) for x in batches for at in range(0, x.num_rows, 256)):
            for doc_id, text, train in zip(b.column(0).to_pylist(), to_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                found = text.lower().split()
                found.append(END)
                cur.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                ids.append(doc_id)
                learned.append(train)
                held += len(found)
                if held >= CHUNK:
                    yield from asked(chunk, ids, learned, cur, known)
                    chunk += 1
                    known, ids, learned, cur, held = numbers(), [], [], [], 0
        if ids:
            yield from asked(chunk, ids, learned, cur, known)

    def numbers() -> defaultdict:
        """Numbers words in the order in which they are first asked for."""
        known: defaultdict = defaultdict()
        known.default_factory = known.__len__
        return known

    def asked(chunk: int, ids: list, learned: list, texts: list[np.ndarray], known: defaultdict) -> Iterator[pa.RecordBatch]:
        sizes, cur = [len(t) for t in texts], np.concatenate(texts)
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in known], np.uint64) & _MASK
        order = np.argsort(h)
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        h, cur = h[order], rank[cur]
        prev = np.r_[rank[known[END]], cur[:-1]]
        prev[np.cumsum(sizes)[:-1]] = rank[known[END]]
        slice_of = (h % np.uint64(g)).astype(np.int64)
        block = slice_of[prev] * g + slice_of[cur]
        code = (block * len(h) + cur) * len(h) + prev
        if g * g * len(h) ** 2 >= 1 << 62:
            raise ValueError("a chunk has too many distinct words")
        code, at = np.unique(code, return_inverse=True)
        train = np.repeat(np.array(learned, bool), sizes)
        n = np.bincount(at[train], minlength=len(code))
        del block, cur, prev
        u, code = code % len(h), code // len(h)
        w, block = code % len(h), code // len(h)
        flags = np.array([(1 if t else 0) + (2 if i is None else 0) for t, i in zip(learned, ids, strict=True)], np.uint8)
        yield _batch(_ENCODED, [{"kind": "texts", "chunk": chunk, "block": -1, "ids": pack(np.array([i or 0 for i in ids], np.int64)), "sizes": pack(np.array(sizes, np.uint32)), "at": pack(at.astype(np.uint32)), "flags": pack(flags)}])
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        rows = []
        for lo, hi in zip(starts, [*starts[1:], len(block)], strict=True):
            own_w, per_w = np.unique(w[lo:hi], return_counts=True)
            own_u, ui = np.unique(u[lo:hi], return_inverse=True)
            rows.append({"kind": "asked", "chunk": chunk, "block": int(block[lo]), "ws": pack(h[own_w], True), "per_w": pack(per_w.astype(np.uint32)), "us": pack(h[own_u], True), "ui": pack(ui.astype(np.uint32)), "n": pack(n[lo:hi].astype(np.uint32))})
        yield _batch(_ENCODED, rows)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    return rows.mapInArrow(encode_task, _ENCODED_SQL)


def _spans(t: pa.Table, key: str) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each value of `key` in a table sorted by it."""
    k = t[key].to_numpy()
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(k)], strict=True):
        yield int(k[lo]), t.slice(lo, hi - lo).to_pylist()


class Block:
    """The pairs that all chunks ask of a block: distinct words, pairs and their training counts, chunks' places.

    `seen` marks the pairs met in training, and wi, ui and c are theirs; `at` has each chunk's places in `every`.
    """

    def __init__(self, asked: list[dict]):
        w = [unpack(r["ws"], np.uint64, True) for r in asked]
        u = [unpack(r["us"], np.uint64, True) for r in asked]
        self.ws, self.us = np.unique(np.concatenate(w)), np.unique(np.concatenate(u))
        codes = []
        for k, r in enumerate(asked):
            wi = np.repeat(np.searchsorted(self.ws, w[k]), unpack(r["per_w"], np.uint32))
            codes.append(wi * len(self.us) + np.searchsorted(self.us, u[k])[unpack(r["ui"], np.uint32)])
            w[k] = u[k] = None
        sizes = [len(x) for x in codes]
        codes = np.concatenate(codes)
        self.every, at = np.unique(codes, return_inverse=True)
        del codes
        at = at.astype(np.int32)
        c = np.bincount(at, weights=np.concatenate([unpack(r["n"], np.uint32) for r in asked])).astype(np.int64)
        self.at = np.split(at, np.cumsum(sizes)[:-1])
        self.seen = c > 0
        self.c = c[self.seen]
        self.wi, self.ui = (x[self.seen] for x in self.words())

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Second and first word of every pair."""
        return self.every // len(self.us), self.every % len(self.us)

    def sums(self, side: str, values: np.ndarray) -> np.ndarray:
        at, size = (self.wi, len(self.ws)) if side == "w" else (self.ui, len(self.us))
        return np.bincount(at, weights=values, minlength=size).astype(np.int64)


_TOLD = pa.schema([("kind", pa.string()), ("block", pa.int32()), ("slice", pa.int32())] + [(n, pa.binary()) for n in ("words", "a", "b", "at_w", "at_u", "c", "t")] + [("n1", pa.int64()), ("n2", pa.int64())])
_TOLD_SQL = "kind string, block int, slice int, words binary, a binary, b binary, at_w binary, at_u binary, c binary, t binary, n1 long, n2 long"


def counted(asked: DataFrame, g: int) -> DataFrame:
    """Of each block: its words to the slices with their customers and dishes of one customer; its other dishes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "block"):
            for block, rows in _spans(t, "block"):
                b = Block(rows)
                one = b.c == 1
                more = ~one
                out = [{"kind": side, "block": block, "slice": 2 * (block % g) if side == "w" else 2 * (block // g) + 1, "words": pack(words, True), "a": pack(b.sums(side, b.c)), "b": pack(b.sums(side, one))} for side, words in (("w", b.ws), ("u", b.us))]
                out.append({"kind": "seats", "block": block, "at_w": pack(b.wi[more].astype(np.uint32)), "at_u": pack(b.ui[more].astype(np.uint32)), "c": pack(b.c[more]), "n1": int(one.sum()), "n2": int((b.c == 2).sum())})
                yield _batch(_TOLD, out)

    return _dealt(asked, "block", g * g).mapInArrow(count, _TOLD_SQL)


def _dealt(rows: DataFrame, key: str, parts: int, *then: str) -> DataFrame:
    return rows.repartition(max(1, parts), key).sortWithinPartitions(key, *then)


def seats(c: np.ndarray, p: np.ndarray, rest: np.ndarray, theta: float, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish of c customers, sampled; p is its probability in the parent restaurant, `rest` how
    many tables of its restaurant serve other dishes. Up to LARGE customers: Gibbs scans over single customers,
    each leaving its table and taking a seat anew. More are seated in groups that grow by an eighth."""
    t = np.ones(len(c), np.int64)
    big = np.flatnonzero(c > LARGE)
    if len(big):
        n, tb, cb = np.ones(len(big), np.int64), np.ones(len(big), np.int64), c[big]
        while (n < cb).any():
            m = np.minimum(np.maximum(1, n // 8), cb - n)
            new = (theta + d * (rest[big] + tb)) * p[big]
            tb += rng.binomial(m, new / (new + n + m / 2 - d * tb))
            n += m
        t[big] = tb
    order = np.flatnonzero((c > 1) & (c <= LARGE))
    order = order[np.argsort(-c[order], kind="stable")]
    if not len(order):
        return t
    cs, ps, rs = c[order], p[order], rest[order]
    start = np.cumsum(cs) - cs
    seat = np.zeros(int(cs.sum()), np.int64)  # of each customer, from the dish's first
    size = np.zeros(len(seat), np.int64)
    size[start] = cs
    ts = np.ones(len(order), np.int64)
    for _ in range(SCANS):
        for k in range(int(cs[0])):
            m = int(np.searchsorted(-cs, -k, "left"))  # dishes with more than k customers
            o, n = start[:m], cs[:m] - 1
            at = o + seat[o + k]
            size[at] -= 1
            ts[:m] -= size[at] == 0
            new = (theta + d * (rs[:m] + ts[:m])) * ps[:m]
            opens = rng.random(m) * (new + n - d * ts[:m]) < new
            todo = np.flatnonzero(~opens)  # joins the table of another customer, in proportion to its size less d
            while len(todo):
                other = (k + 1 + (rng.random(len(todo)) * n[todo]).astype(np.int64)) % cs[todo]
                s = seat[o[todo] + other]
                held = size[o[todo] + s]
                ok = rng.random(len(todo)) * held < held - d
                seat[o[todo[ok]] + k] = s[ok]
                todo = todo[~ok]
            todo = np.flatnonzero(opens)  # takes a free table; there is one, as tables are no fewer than customers
            while len(todo):
                s = (rng.random(len(todo)) * cs[todo]).astype(np.int64)
                ok = size[o[todo] + s] == 0
                seat[o[todo[ok]] + k] = s[ok]
                todo = todo[~ok]
            size[o + seat[o + k]] += 1
            ts[:m] += opens
    t[order] = ts
    return t


_SLICE = pa.schema([("kind", pa.string()), ("slice", pa.int32()), ("block", pa.int32())] + [(n, pa.binary()) for n in ("words", "a", "b", "t", "top")] + [(n, pa.int64()) for n in ("n", "v", "n1", "n2", "sum_t", "sum_top")])
_SLICE_SQL = "kind string, slice int, block int, words binary, a binary, b binary, t binary, top binary, n long, v long, n1 long, n2 long, sum_t long, sum_top long"


def _summed(words: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, at = np.unique(np.concatenate(words), return_inverse=True)
    return every, np.bincount(at, weights=np.concatenate(values), minlength=len(every)).astype(np.int64)


def totalled(told: DataFrame, g: int, top: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """Slices from what blocks told of their words, and an answer for each block.

    told: slice, block, words, a (customers), b (tables). A slice's row (kind slice) has the sums, and for
    dishes the tables of the parent restaurant; an answer has the sums of the block's words, in its order.
    """

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "slice"):
            for k, rows in _spans(table, "slice"):
                words = [unpack(r["words"], np.uint64, True) for r in rows]
                every, a = _summed(words, [unpack(r["a"], np.int64) for r in rows])
                _, t = _summed(words, [unpack(r["b"], np.int64) for r in rows])
                dishes = k % 2 == 0
                up = top(t, k) if dishes else np.zeros(0, np.int64)
                yield _batch(_SLICE, [{"kind": "slice", "slice": k, "n": int(a.sum()) if dishes else 0, "v": int((a > 0).sum()) if dishes else 0, "n1": int((t == 1).sum()) if dishes else 0, "n2": int((t == 2).sum()) if dishes else 0, "sum_t": int(t.sum()) if dishes else 0, "sum_top": int(up.sum())}])
                for r, own in zip(rows, words, strict=True):
                    at = np.searchsorted(every, own)
                    yield _batch(_SLICE, [{"kind": "w" if dishes else "u", "slice": k, "block": r["block"], "a": pack(a[at]), "t": pack(t[at]), "top": pack(up[at]) if dishes else b""}])

    return _dealt(told, "slice", 2 * g).mapInArrow(total, _SLICE_SQL)


class Table:
    """A table written into the shared folder, with a folder for each value of `by`, until it is dropped.

    The shuffle files that the write leaves go with it, as later steps read the table.
    """

    def __init__(self, df: DataFrame, name: str, by: str | None = None):
        self.spark, self.schema, self.by = df.sparkSession, df.schema, by
        self.path = f"{shared_dir(self.spark)}/tallyfold/{name}-{uuid.uuid4().hex}"
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, None)
        conf.set(key, "true")
        try:
            (df.write.partitionBy(by) if by else df.write).parquet(self.path)
        finally:
            conf.set(key, before) if before is not None else conf.unset(key)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self, value: str | None = None) -> None:
        """Leaves no rows, or none of one folder; nothing that is still to run may need them."""
        empty = self.spark.createDataFrame([], self.schema if value is None else "gone int")
        empty.write.mode("overwrite").parquet(self.path if value is None else f"{self.path}/{self.by}={value}")


class Totals:
    """Sums over all slices; one row."""

    def __init__(self, slices: DataFrame):
        r = slices.where("kind = 'slice'").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n1", "n2", "sum_t", "sum_top")]).first()
        self.n, self.v, self.tables, self.top = r["n"], r["v"], r["sum_t"], r["sum_top"]
        self.discount = _discount(r["n1"], r["n2"])


def _discount(n1: int, n2: int) -> float:
    """Estimated from how many dishes have one and two customers."""
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


def parent(t: np.ndarray, top: np.ndarray, sums: Totals, d: float, theta: float = PARENT_STRENGTH) -> np.ndarray:
    """Probability of each word in the unigram restaurant of t customers at `top` tables of that word."""
    return (t - d * top + (theta + d * sums.top) / (sums.v + 1)) / (theta + sums.tables)


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", burn: int = BURN, kept: int = KEPT, seed: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of `docs`.

    Tokens are words parted by ASCII white space, A-Z lower-cased, and one end. The model learns from the rows
    where `learn` holds; all others (null ids too) are held out. base_score: log10 probability under counts
    plus one; score: under the sampled model. Null and empty texts are the end alone. Texts are read whole;
    repeated rows are learned from and come back as often as they come in; without a training row all words
    have probability 1 / (V + 1) = 1; an empty table gives no rows; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    chars = docs.agg(F.coalesce(F.sum(F.length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    g = max(1, round((chars / BLOCK_CHARS) ** 0.5))
    chunks = Table(encode(docs, learn, g, id_col, text_col), "lm-chunks", by="kind")
    asked = chunks.read().where("kind = 'asked'").select("chunk", "block", "ws", "per_w", "us", "ui", "n")
    counts = Table(counted(asked, g), "lm-counts")
    told = counts.read()
    of_dishes = told.where("kind = 'seats'").agg(F.sum("n1"), F.sum("n2")).first()
    discount = _discount(of_dishes[0] or 0, of_dishes[1] or 0)
    # At first each dish has a table: those of one customer stay so, and the others begin with one.
    slices = Table(totalled(_seated(told, told, g), g, lambda t, k: np.minimum(t, 1)), "lm-slices")
    sums = Totals(slices.read())
    top_discount, samples = sums.discount, []
    for sweep in range(burn + kept):
        state = Table(_sweep(told, slices.read(), sums, g, discount, top_discount, seed + 1000 * sweep), "lm-seats")
        if sweep <= burn:
            slices.drop()
        slices = Table(totalled(_seated(told, state.read(), g), g, _parent_seats(sums.v, sums.top, top_discount, seed + 1000 * sweep)), "lm-slices")
        sums = Totals(slices.read())
        if sweep >= burn:
            samples.append((state.read(), slices.read(), sums))
        else:
            state.drop()
    counts.drop()
    answers = Table(_answers(asked, samples, g, discount, top_discount), "lm-answers")
    chunks.drop("asked")
    return _by_document(chunks.read().where("kind = 'texts'"), answers.read(), sums, max(1, chars // (6 * CHUNK)), id_col)


def _seated(told: DataFrame, state: DataFrame, g: int) -> DataFrame:
    """What blocks tell slices: customers, and tables of dishes of one customer and of the others."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "block"):
            for block, rows in _spans(t, "block"):
                mine = next(r for r in rows if r["kind"] == "seats")
                tables = unpack(mine["t"], np.int64) if mine["t"] is not None else np.ones(len(unpack(mine["c"], np.int64)), np.int64)
                out = []
                for r in rows:
                    if r["kind"] != "seats":
                        one = unpack(r["b"], np.int64)
                        at = unpack(mine["at_" + r["kind"]], np.uint32)
                        more = np.bincount(at, weights=tables, minlength=len(one)).astype(np.int64)
                        out.append({"kind": r["kind"], "block": block, "slice": r["slice"], "words": r["words"], "a": r["a"], "b": pack(one + more)})
                yield _batch(_TOLD, out)

    return _dealt(told.where("kind <> 'seats'").unionByName(state.where("kind = 'seats'")), "block", g * g).mapInArrow(tell, _TOLD_SQL)


def _parent_seats(v: int, top: int, d: float, seed: int):
    """Tables of the unigram restaurant: its customers are seated anew in each sweep, given the sweep before."""

    def sit(t: np.ndarray, k: int) -> np.ndarray:
        rng = np.random.default_rng([seed, k])
        return np.where(t > 0, seats(np.maximum(t, 1), np.full(len(t), 1 / (v + 1)), np.full(len(t), max(0, top - 1)), PARENT_STRENGTH, d, rng), 0)

    return sit


def _sweep(told: DataFrame, slices: DataFrame, sums: Totals, g: int, d: float, top_d: float, seed: int) -> DataFrame:
    """The seats of all dishes of two customers or more, given the slices' totals."""

    def sit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "block"):
            for block, rows in _spans(t, "block"):
                by = {r["kind"]: r for r in rows}
                mine, dish, room = by["seats"], by["w"], by["u"]
                c, wi, ui = unpack(mine["c"], np.int64), unpack(mine["at_w"], np.uint32), unpack(mine["at_u"], np.uint32)
                p = parent(unpack(dish["t"], np.int64), unpack(dish["top"], np.int64), sums, top_d)[wi]
                rest = np.maximum(0, unpack(room["t"], np.int64)[ui] - 1)
                tables = seats(c, p, rest, STRENGTH, d, np.random.default_rng([seed, block]))
                yield _batch(_TOLD, [{"kind": "seats", "block": block, "at_w": mine["at_w"], "at_u": mine["at_u"], "c": mine["c"], "t": pack(tables)}])

    cols = ("kind", "block", "at_w", "at_u", "c", "t", "top")
    mine = told.where("kind = 'seats'").withColumn("top", F.lit(None).cast("binary")).select(*cols)
    known = slices.where("kind <> 'slice'").select("kind", "block", *[F.lit(None).cast("binary").alias(x) for x in ("at_w", "at_u", "c")], "t", "top")
    return _dealt(mine.union(known), "block", g * g).mapInArrow(sit, _TOLD_SQL)


_ANSWER = pa.schema([("chunk", pa.int64()), ("block", pa.int32()), ("p", pa.binary()), ("per_w", pa.binary()), ("c", pa.binary())])


def _answers(asked: DataFrame, samples: list, g: int, d: float, top_d: float) -> DataFrame:
    """For each chunk and block the log10 probabilities of its pairs, and the training counts of its second words."""
    totals = [s[2] for s in samples]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "block"):
            for _, rows in _spans(t, "block"):
                asks = [r for r in rows if r["kind"] == "asked"]
                if not asks:
                    continue
                b = Block(asks)
                wi, ui = b.words()
                total = np.zeros(len(b.every))
                for s, sums in enumerate(totals):
                    by = {r["kind"]: r for r in rows if r["sample"] == s}
                    tables = np.ones(len(b.c), np.int64)
                    tables[b.c > 1] = unpack(by["seats"]["t"], np.int64)
                    p = parent(unpack(by["w"]["t"], np.int64), unpack(by["w"]["top"], np.int64), sums, top_d)[wi]
                    c_u, t_u = unpack(by["u"]["a"], np.int64)[ui], unpack(by["u"]["t"], np.int64)[ui]
                    own = np.zeros(len(b.every))
                    own[b.seen] = b.c - d * tables
                    total += np.where(c_u > 0, (own + (STRENGTH + d * t_u) * p) / (STRENGTH + c_u), p)
                c_w = unpack(by["w"]["a"], np.int64)
                # 16 bits of each logarithm's fraction are passed on, far below what the sampling leaves open
                log = np.log10(total / len(totals)).astype(np.float32).view(np.uint32)
                log = ((log + np.uint32(0x80)) & np.uint32(0xFFFFFF00)).view(np.float32)
                for r, at in zip(asks, b.at, strict=True):
                    own = np.searchsorted(b.ws, unpack(r["ws"], np.uint64, True))
                    yield _batch(_ANSWER, [{"chunk": r["chunk"], "block": r["block"], "p": pack(log[at]), "per_w": r["per_w"], "c": pack(c_w[own])}])

    none = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    rows = asked.select(F.lit("asked").alias("kind"), F.lit(-1).alias("sample"), "chunk", "block", "ws", "per_w", "us", "ui", "n", *none("a", "t", "top"))
    for s, (state, slices, _) in enumerate(samples):
        head = lambda t, s=s: t.select("kind", F.lit(s).alias("sample"), F.lit(None).cast("long").alias("chunk"), "block", *none("ws", "per_w", "us", "ui", "n"), *(["a", "t", "top"] if "top" in t.columns else [*none("a"), "t", *none("top")]))
        rows = rows.union(head(state.where("kind = 'seats'"))).union(head(slices.where("kind <> 'slice'")))
    return _dealt(rows, "block", g * g, "kind", "chunk").mapInArrow(answer, "chunk long, block int, p binary, per_w binary, c binary")


def _by_document(texts: DataFrame, answers: DataFrame, sums: Totals, parts: int, id_col: str) -> DataFrame:
    n, v = sums.n, sums.v

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "chunk"):
            for _, rows in _spans(t, "chunk"):
                docs, rest = rows[0], rows[1:]  # block -1 first, then the blocks in the order of the pairs
                p = np.concatenate([unpack(r["p"], np.float32) for r in rest]).astype(float)
                c = np.concatenate([np.repeat(unpack(r["c"], np.int64), unpack(r["per_w"], np.uint32)) for r in rest])
                base = np.log10((c + 1) / (n + v + 1))
                at, sizes, flags = unpack(docs["at"], np.uint32), unpack(docs["sizes"], np.uint32).astype(np.int64), unpack(docs["flags"], np.uint8)
                starts = np.cumsum(sizes) - sizes
                by_doc = lambda x: np.add.reduceat(x[at], starts)
                total = by_doc(p)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(unpack(docs["ids"], np.int64), pa.int64(), mask=(flags & 2) > 0), pa.array((flags & 1) == 0), pa.array(sizes), pa.array(by_doc((c > 0).astype(np.int64))),
                        pa.array(np.full(len(sizes), n, np.int64)), pa.array(by_doc(base)), pa.array(total), pa.array(10 ** (-total / sizes)),
                    ],
                    names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    none = lambda *names: [F.lit(None).cast("binary").alias(x) for x in names]
    docs = texts.select("chunk", "block", "ids", "sizes", "at", "flags", *none("p", "per_w", "c"))
    met = docs.union(answers.select("chunk", "block", *none("ids", "sizes", "at", "flags"), "p", "per_w", "c"))
    return _dealt(met, "chunk", parts, "block").mapInArrow(add, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
