"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

The labelled documents are dealt into blocks by their hashed ids; each block trains its weights in a task of its
own, and the model is the blocks' mean, each counting by its documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import to_bytes

BUCKETS = 1 << 18
BLOCK = 8000  # labelled documents of a block, about; every one is in a block
_UNIT = 1 << 24  # weights are summed in whole numbers, so their order does not matter
_PIECE = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]")


class Features:
    """Hashed unigrams and bigrams of words and punctuation marks: log counts, of unit length.

    Bucket 0 is the bias; buckets 1 to 11 say which tenth of the bigrams repeat an earlier one.
    """

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        pieces, known = _PIECE.findall(text), self.known
        try:
            ids = np.array([known[w] for w in pieces], np.uint64)
        except KeyError:
            if len(known) > 500_000:
                known.clear()
            for w in pieces:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            ids = np.array([known[w] for w in pieces], np.uint64)
        if not len(ids):
            return np.zeros(1, np.int32), np.ones(1, np.float32)
        two = ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:]
        two ^= two >> np.uint64(29)
        at = np.concatenate([ids >> np.uint64(40), (two * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)]).astype(np.int32) % (BUCKETS - 16) + 16
        at, count = np.unique(at, return_counts=True)
        again = 1 + 10 * (len(two) - len(np.unique(two))) // max(1, len(two))
        value = np.log1p(count).astype(np.float32)
        value *= 1 / np.sqrt(np.dot(value, value))
        return np.r_[np.int32(0), np.int32(again), at], np.r_[np.float32(1), np.float32(1), value]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """Weights after `epochs` passes of per-coordinate FTRL-proximal updates in the given order."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    weight = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    for _ in range(epochs):
        for at, value, label in rows:
            zs, ns = z[at], n[at]
            w = weight(zs, ns)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            grown = ns + g * g
            z[at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / alpha * w
            n[at] = grown
    return weight(z, n)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", block: int = BLOCK, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.1, epochs: int = 4) -> np.ndarray:
    """Weights learned from every labelled document, in blocks of about `block` by hashed ids.

    A block's passes run in one task, in the order of hashed ids. Labels other than 0 and 1 and null ids are
    left out; of a document's repeated labels the largest counts, of its repeated rows the text with the
    smallest hash. Without any labelled document all weights are 0. Of `docs` only doc_id and text are read.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    chosen = chosen.withColumn("rank", F.xxhash64("doc_id"))
    blocks = max(1, -(-chosen.count() // block))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        make = Features()
        made = [make((t or "").encode("utf-8", "replace")) for t in pdf.pop("text")]
        pdf = pdf.assign(n=[len(m[0]) for m in made], at=range(len(made))).sort_values(["rank", "n"], kind="stable")
        w = ftrl([(*made[i], label) for i, label in zip(pdf["at"], pdf["label"], strict=True)], alpha, beta, l1, l2, epochs)
        k = np.flatnonzero(w)
        return pd.DataFrame({"k": np.r_[-1, k].astype(np.int32), "v": np.r_[len(made), np.rint(w[k] * (len(made) * _UNIT))].astype(np.int64)})

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    # An id teaches once, however often its rows repeat; maps pre-aggregate before the shuffle.
    rows = rows.groupBy("doc_id", "rank", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.select(F.pmod("rank", F.lit(blocks)).alias("block"), "rank", "label", "text")
    sums = rows.groupBy("block").applyInPandas(train, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    k, v = sums.column("k").to_numpy(), sums.column("v").to_numpy()
    out = np.zeros(BUCKETS, np.float32)
    out[k[k >= 0]] = v[k >= 0] / (_UNIT * max(1, v[k < 0].sum()))
    return out


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score of every row: the chance of label 1. Null and empty texts get the bias alone.

    Texts are scored whole, each as a sparse dot product with the weights (1 MB, of fixed size). Repeated
    rows and null ids come back as they are; an empty table gives no rows. Only doc_id and text are read.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for b in batches:
            out = []
            for text in to_bytes(b.column(1)):
                at, value = make(text)
                out.append(float(1 / (1 + np.exp(-np.clip(weights[at].astype(float) @ value, -35, 35)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scored, "doc_id long, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score is at least `least`, with all their columns.

    Null and empty texts have the bias's score. Repeated rows and rows with null ids are judged by their
    text alone; a tie with `least` stays.
    """
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for b in batches:
            good = []
            for text in to_bytes(b.column(at)):
                i, value = make(text)
                good.append(bool(1 / (1 + np.exp(-np.clip(weights[i].astype(float) @ value, -35, 35))) >= least))
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
