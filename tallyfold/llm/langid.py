"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A letter trigram is bound as the product of its
letters' vectors, rotated by their place; a text is the bundle (sum) of its trigrams' vectors; a language's
prototype is the sum of its training texts' unit vectors. A text gets the language of the nearest cosine.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.scan import percentiles

DIMENSIONS = 1024
_UNIT = 1_000_000  # prototypes are summed in whole numbers, so their order does not matter
_PIECE = 1 << 20
HELD = 1000  # languages whose sums a task holds
FULL = 128  # trigrams from which a text's cosine is taken as it is; below, it is expected to fall as their root


def letter_of(code: int) -> int:
    """The lower-case letter that a code point stands for; 0 if it is no letter."""
    c = chr(code)
    return ord(c.lower()[0]) if c.isalpha() else 0


class Profiles:
    """Letters are numbered as they are met; a number's meaning never leaves the task."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, -1, np.int32)  # code point to letter number; 0 is a gap
        self.numbers = {0: 0}
        self.vectors = [self._vector(0)]
        self.places: list[np.ndarray] = []

    @staticmethod
    def _vector(letter: int) -> np.ndarray:
        return np.random.default_rng([7, letter]).integers(0, 2, DIMENSIONS, dtype=np.int8) * np.int8(2) - np.int8(1)

    def _numbered(self, codes: np.ndarray) -> np.ndarray:
        out = self.table[codes]
        if (out < 0).any():
            for c in np.unique(codes[out < 0]).tolist():
                letter = letter_of(c)
                if letter not in self.numbers:
                    self.numbers[letter] = len(self.vectors)
                    self.vectors.append(self._vector(letter))
                self.table[c] = self.numbers[letter]
            self.places = []
            out = self.table[codes]
        return out

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigram codes and their counts; words are parted by one gap. Long texts go in pieces."""
        codes, counts, tail = [], [], np.zeros(1, np.int32)
        for i in range(0, len(text), _PIECE):
            c = self._numbered(np.frombuffer(text[i : i + _PIECE].encode("utf-32-le", "replace"), np.uint32))
            c = np.r_[tail, c, np.zeros(int(i + _PIECE >= len(text)), np.int32)]
            c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]
            tail = c[-2:]
            if len(self.vectors) <= 1 << 10:  # the usual alphabets fit shorter codes, which sort faster
                code, count = np.unique((c[:-2] << 20) | (c[1:-1] << 10) | c[2:], return_counts=True)
                code = code.astype(np.int64)
                code = ((code >> 20) << 42) | ((code >> 10 & 1023) << 21) | (code & 1023)
            else:
                c = c.astype(np.int64)
                code, count = np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True)
            codes.append(code)
            counts.append(count)
        if len(codes) <= 1:
            return (codes[0], counts[0]) if codes else (np.zeros(0, np.int64), np.zeros(0, int))
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        return code, np.bincount(at, np.concatenate(counts)).astype(int)

    def bundle(self, profiles: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A unit vector per text; all zeros where there is no letter."""
        code, at = np.unique(np.concatenate([p[0] for p in profiles]), return_inverse=True)
        row = np.repeat(np.arange(len(profiles)), [len(p[0]) for p in profiles])
        dense = np.zeros((len(profiles), len(code)), np.float32)
        dense[row, at] = np.concatenate([p[1] for p in profiles])
        if not self.places:
            letters = np.array(self.vectors)
            self.places = [np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters]
        bound = self.places[0][code >> 42] * self.places[1][(code >> 21) & 0x1FFFFF] * self.places[2][code & 0x1FFFFF]
        out = dense @ bound.astype(np.float32)
        return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)

    def of(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(start, unit vectors) of runs of up to 128 texts."""
        for i in range(0, len(texts), 128):
            yield i, self.bundle([self.trigrams(t or "") for t in texts[i : i + 128]])


def _training(docs: DataFrame, lang_col: str) -> DataFrame:
    return docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototypes by language, from every row with a language.

    Rows with null language, null text or no letter teach nothing; repeated rows teach as often as they
    come. Rows are summed in their tasks, so a task sends about one vector a language; the prototypes, one of 8 kB
    a language, are held by the driver. An empty table gives none. Other columns are ignored.
    """
    labelled = _training(docs, lang_col)

    def summed(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(v)], names=["lang", "k", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, total = Profiles(), defaultdict(lambda: np.zeros(DIMENSIONS, np.int64))
        for b in batches:
            langs = b.column(0).to_pylist()
            for i, vectors in profiles.of(b.column(1).to_pylist()):
                for lang, v in zip(langs[i:], np.rint(vectors * _UNIT).astype(np.int64), strict=False):
                    total[lang] += v
            if len(total) > HELD:
                yield from summed(total)
                total.clear()
        yield from summed(total)

    sums = labelled.mapInArrow(add, "lang string, k int, v long").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("v")).select("lang", "v.v").collect()
    out = {r[0]: np.array(r[1], float) for r in sorted(rows)}
    return {k: v / np.linalg.norm(v) for k, v in out.items() if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score of every row. Null texts and texts without a letter: `und`, score 0.

    The score is the cosine, 0 at least; equal cosines go to the first language by name. Texts are read
    whole. Repeated rows and null ids come back as they are; an empty table gives no rows. Only doc_id and
    text are read; without prototypes every row is `und`.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in names], np.float32).reshape(len(names), DIMENSIONS).T

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles()
        for b in batches:
            langs, scores = [], []
            for _, vectors in profiles.of(b.column(1).to_pylist()):
                if not names:
                    langs += ["und"] * len(vectors)
                    scores += [0.0] * len(vectors)
                    continue
                cosine = vectors @ matrix
                best = cosine.argmax(1)
                some = vectors.any(1)
                langs += [names[k] if s else "und" for k, s in zip(best.tolist(), some.tolist(), strict=True)]
                scores += np.where(some, np.clip(cosine.max(1), 0, 1), 0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(label, "doc_id long, lang_pred string, score double")


def _measured(profiles: Profiles, texts: list[str | None], matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, cosines, shrinkage by trigrams) of runs of up to 128 texts."""
    for i in range(0, len(texts), 128):
        found = [profiles.trigrams(t or "") for t in texts[i : i + 128]]
        yield i, profiles.bundle(found) @ matrix, np.sqrt(np.minimum(1, np.array([c.sum() for _, c in found]) / FULL))


def limits(docs: DataFrame, prototypes: dict[str, np.ndarray], lang_col: str = "lang") -> dict[str, float]:
    """By language, half the 1st percentile of the cosines of all its training rows with its prototype.

    Cosines of texts under 128 trigrams are first divided by the root of their share of 128. Percentiles are
    exact, over ranges of rows, so no language's cosines stand in one task.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in names], np.float32).reshape(len(names), DIMENSIONS).T

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles()
        for b in batches:
            langs, kept, out = b.column(0).to_pylist(), [], []
            for i, cosine, part in _measured(profiles, b.column(1).to_pylist(), matrix):
                for lang, c, p in zip(langs[i:], cosine, part, strict=False):
                    if lang in prototypes and c.any():
                        kept.append(lang)
                        out.append(float(c[names.index(lang)] / p))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(out, pa.float64())], names=["lang", "cosine"])

    measured = _training(docs, lang_col).mapInArrow(measure, "lang string, cosine double")
    return {r["lang"]: r["low"] / 2 for r in percentiles(measured, ["lang"], "cosine", {"low": 0.01}).collect()}


def keep_known(docs: DataFrame, prototypes: dict[str, np.ndarray], least: float, limits: dict[str, float] | None = None) -> DataFrame:
    """The rows of `docs` in a known language, with all their columns.

    The nearest cosine must be at least `least` and at least its language's limit, which is shrunk for
    texts under 128 trigrams, so short clean texts stay. Null texts and texts without a letter go; repeated
    rows and rows with null ids are judged by their text alone; other columns are not read and stay.
    """
    at = docs.columns.index("text")
    matrix = np.array(list(prototypes.values()), np.float32).reshape(len(prototypes), DIMENSIONS).T
    limit = np.array([(limits or {}).get(k, 0.0) for k in prototypes])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles()
        for b in batches:
            good = []
            for _, cosine, part in _measured(profiles, b.column(at).to_pylist(), matrix) if matrix.size else ():
                good.append(cosine.max(1) >= np.maximum(least, limit[cosine.argmax(1)] * part))
            yield b.filter(pa.array(np.concatenate(good), pa.bool_())) if good else b.slice(0, 0)

    return docs.mapInArrow(keep, docs.schema)
