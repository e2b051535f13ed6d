"""Spelling variants of the words of a corpus by PartEnum signatures.

A word's letters are a multiset, and that a binary vector: its dimension (letter, k) is set if the word has
the letter k times or more. One inserted, deleted or replaced letter changes at most two dimensions. The
dimensions are dealt into FIRST * SECOND parts. Of two vectors that differ in two dimensions or fewer, some
one of the FIRST groups of parts has few differing parts, so that among the ways to leave that many parts
out, one leaves only equal parts. Each way is a signature: the hash of what the word has in the parts kept.
One edit also leaves the first or the last half of the shorter word as it is, so signatures come with either
half's hash. Words that share one are met by an equality join and verified by their edit distance.

What is joined are distinct words, not places in texts. A word has at most a few thousand near words
(positions times letters), so neither forms nor roots have keys that hold most rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import staged, to_bytes

FIRST, SECOND = 1, 4  # parts of the vector: groups, and parts in each
LEAST_LETTERS, LEAST_COUNT = 6, 5
HELD = 400_000  # distinct words counted in a task before they are passed on
BROADCAST_FORMS = 100_000  # of about 100 bytes; more are joined by a shuffle

_RUN = re.compile("[a-zÀ-ÿ]+")


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, typo_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z lower-cased, of `least_letters` or more.

    With `typo_every` d, a run loses a letter in documents where d divides h, the crc32 of `<id>:<run>`: the
    one at h modulo its length. Rows without an id lose none. Words are counted within a task before they
    are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), to_bytes(b.column(1)), strict=True):
                found = Counter(_RUN.findall(text.lower().decode()))
                if typo_every and doc_id is not None:
                    start = zlib.crc32(f"{doc_id}:".encode())
                    for run in [r for r in found if len(r) > least_letters]:
                        h = zlib.crc32(run.encode(), start)
                        if h % typo_every == 0:
                            at = h % len(run)
                            total[run[:at] + run[at + 1 :]] += found.pop(run)
                    for run in [r for r in found if len(r) == least_letters and zlib.crc32(r.encode(), start) % typo_every == 0]:
                        del found[run]
                for run, n in found.items():
                    if len(run) >= least_letters:
                        total[run] += n
                if len(total) > HELD:
                    yield rows(total)
                    total = Counter()
        yield rows(total)

    def rows(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kept_parts(distance: int, first: int = FIRST, second: int = SECOND) -> list[list[int]]:
    """The parts that each signature keeps: in a group of `second` parts, all but as many as may differ there."""
    spare = -(-(distance + 1) // first) - 1
    if spare >= second:
        raise ValueError("a group needs more parts than may differ in it")
    return [[g * second + p for p in keep] for g in range(first) for keep in combinations(range(second), second - spare)]


class Words:
    """The letters of some words, flat, with what their signatures are made from."""

    def __init__(self, words: list[str], first: int = FIRST, second: int = SECOND):
        self.size = np.array([len(w) for w in words], np.int64)
        self.first, self.second = first, second
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        word = np.repeat(np.arange(len(words)), self.size)
        self.start = np.cumsum(self.size) - self.size
        place = (np.arange(len(word)) - self.start[word]).astype(np.uint64)
        back = self.size[word].astype(np.uint64) - place
        # running sums of hashes of (letter, place), so that the hash of any first or last letters is a difference
        self.ahead = np.r_[np.uint64(0), np.cumsum(_mix(letters + (place << np.uint64(32))), dtype=np.uint64)]
        self.behind = np.r_[np.uint64(0), np.cumsum(_mix(letters + (back << np.uint64(32))), dtype=np.uint64)]
        order = np.lexsort((letters, word))
        word, letters = word[order], letters[order]
        starts = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (letters[1:] != letters[:-1])][: len(word)])
        k = np.arange(len(word)) - np.repeat(starts, np.diff(np.r_[starts, len(word)]))  # how often the letter was there before
        dimension = _mix((letters << np.uint64(20)) + k.astype(np.uint64) + np.uint64(1))
        part = ((dimension >> np.uint64(40)) % np.uint64(first * second)).astype(np.int64)
        held = np.zeros((len(words), first * second), np.uint64)
        np.add.at(held, (word, part), dimension)
        self.parts = _mix(held + np.arange(1, first * second + 1, dtype=np.uint64))

    def signatures(self, distance: int, shorter: np.ndarray) -> np.ndarray:
        """For each word its signatures for vectors up to `distance` apart, each with either half.

        `shorter` is the length of the shorter word of a pair: its first or its last half is untouched.
        """
        half, end = shorter // 2, self.start + self.size
        halves = (self.ahead[self.start + half] - self.ahead[self.start], self.behind[end] - self.behind[end - half])
        kept = kept_parts(distance, self.first, self.second)
        parts = [self.parts[:, keep].sum(axis=1, dtype=np.uint64) for keep in kept]
        kind = np.uint64(distance << 20) + shorter.astype(np.uint64)
        out = [_mix(_mix(h + np.uint64(side)) + _mix(p + np.uint64(i + 1)) + _mix(kind)) for side, h in enumerate(halves) for i, p in enumerate(parts)]
        return np.stack(out, axis=1).view(np.int64)


def near_pairs(words: DataFrame, first: int = FIRST, second: int = SECOND) -> DataFrame:
    """word, other for every two different words of `words` (column word) one edit apart, both ways round, once.

    Words of equal length differ in two dimensions, words of lengths one apart in one; of either kind one half
    is equal, and its hash is part of the signature, so that few words meet that are not near. Spark sizes
    the signatures by the words they are made from, a small part of what they are, so the join names its kind:
    else they would be broadcast.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 5000):
                part = b.slice(at, 5000).column(0)
                w = Words(part.to_pylist(), first, second)
                for role, s in enumerate((w.signatures(2, w.size), w.signatures(1, w.size), w.signatures(1, w.size - 1))):
                    again = pa.array(np.repeat(np.arange(len(part)), s.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(s.ravel()), pa.array(np.full(s.size, role, np.int8)), part.take(again)], names=["s", "role", "word"])

    # roles: 0 among words of equal length, 1 the shorter and 2 the longer of two
    signed = words.where("word is not null and word <> ''").select("word").mapInArrow(sign, "s long, role byte, word string")
    a, b = signed.where("role < 2").alias("a"), signed.where("role <> 1").alias("b").hint("merge")
    roles = ((F.col("a.role") == 0) & (F.col("a.word") < F.col("b.word"))) | (F.col("a.role") == 1)
    met = a.join(b, (F.col("a.s") == F.col("b.s")) & roles & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
    pairs = met.select(F.col("a.word").alias("word"), F.col("b.word").alias("other")).distinct()
    return pairs.select(F.explode(F.array(F.struct("word", "other"), F.struct(F.col("other").alias("word"), F.col("word").alias("other")))).alias("p")).select("p.*")


def spelling_forms(counts: DataFrame, ratio: int = 5, first: int = FIRST, second: int = SECOND) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of `counts` (distinct word, n).

    Near words differ by exactly one inserted, deleted or replaced code point. form is the near word of
    largest n (of equal ones the first in code-point order) if that is at least `ratio` times the word's own;
    root follows forms to the last, which ends as n grows with each. Words are compared as given; an empty
    table gives no rows.
    """
    near = near_pairs(counts, first, second).join(counts.select(F.col("word").alias("other"), F.col("n").alias("m")).hint("merge"), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("b"))
    enough = -F.col("b.less") >= ratio * F.col("n")
    rows = counts.select("word", "n").join(best, "word", "left")
    rows = staged(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("b.other")).alias("form"), F.when(enough, -F.col("b.less")).alias("form_n")), "forms")
    # Each step doubles how far a root reaches; n grows at least `ratio`-fold a form, so a few steps do.
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        step = roots.alias("a").join(_small(roots.select(F.col("word").alias("root"), F.col("root").alias("next"))), "root", "left")
        step = staged(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    out = rows.join(_small(roots), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_FORMS else rows.hint("merge")  # Spark goes by their compressed size


def spelling_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = 5, typo_every: int | None = None, **columns) -> DataFrame:
    """spelling_forms of the words of `docs` that have `least_letters` and occur `least_count` times in all.

    Null and empty texts have no words; long texts are read whole; repeated rows count as often as they come;
    other columns are ignored.
    """
    counts = word_counts(docs, least_letters, typo_every, **columns).where(F.col("n") >= least_count)
    return spelling_forms(staged(counts, "words"), ratio)
