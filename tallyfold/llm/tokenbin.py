"""Token ids in a binary format: frequency-ranked, byte-aligned, lengths in separate control bytes.

Texts are encoded by the tokenizers library; ids are ranked by their frequency in the corpus, so frequent
ids take one byte. A block holds whole documents in ascending id order:

    magic "TFB1", documents n, ids m (two little-endian uint64), n ids of documents (int64),
    n id counts (int64), ceil(m / 4) control bytes (two bits an id: its bytes less one), data bytes

Blocks are rows of a Parquet table in the shared folder, one group of files per shard of consecutive
document ids, so Spark's committed writes and lost tasks' retries hold. A second table holds the ranks.
"""

from __future__ import annotations

import os
import struct
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import shared_dir, staged

MAGIC = b"TFB1"
BLOCK_IDS = 1 << 20
SHARD_IDS = 1 << 24
SLICE_BYTES = 1 << 23  # of text encoded in one piece; a longer text is one piece
MAX_LEARNED = 500_000  # pieces a worker keeps, of about 200 bytes each
_JOINED = 1000  # new words encoded by one call
_SPACE = "\u0120"  # what byte-level models write for a space
# Lengths of the four ids of a control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)

# Kinds of bytes: 1 white space or control, 2 ASCII letter or digit.
_KIND = np.zeros(256, np.uint8)
_KIND[[0, *range(9, 14), *range(28, 33)]] = 1
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 2


def _wide_space(b: np.ndarray) -> bool:
    """Whether UTF-8 bytes hold a white-space character beyond ASCII."""

    def follows(lead: int, *rest: tuple[int, ...]) -> bool:
        at = np.flatnonzero(b[: len(b) - len(rest)] == lead)
        for k, allowed in enumerate(rest, 1):
            at = at[np.isin(b[at + k], allowed)]
        return bool(len(at))

    if not len(b) or b.max() < 0x80:
        return False
    return follows(0xC2, (0x85, 0xA0)) or follows(0xE1, (0x9A,), (0x80,)) or follows(0xE2, (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)) or follows(0xE2, (0x81,), (0x9F,)) or follows(0xE3, (0x80,), (0x80,))


def cuts(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces of the texts in UTF-8 bytes `b` start; texts start at `starts`.

    Byte-level pre-tokenization always starts a new pre-token at a single space between two characters that
    are not white space, on both sides of a single line break, and before a full stop or comma after a
    letter or digit; merges never cross pre-tokens. Texts are cut only there.
    """
    cut = np.zeros(len(b) + 1, bool)
    if len(b) and not _wide_space(b):
        kind = _KIND[b]
        solid = kind != 1
        before, after = np.r_[True, solid[:-1]], np.r_[solid[1:], True]
        alone = before & after & ~solid
        cut[:-1] = alone & ((b == 32) | (b == 10))
        cut[1:] |= alone & (b == 10)
        mark = np.flatnonzero((b == 44) | (b == 46))
        mark = mark[mark > 1]
        last, lead = b[mark - 1], b[mark - 2]
        # After an ASCII letter or digit, or a letter of Latin-1 (C3 80 to C3 BF without the two signs).
        cut[mark[(kind[mark - 1] == 2) | ((lead == 0xC3) & (last != 0x97) & (last != 0xB7))]] = True
    # A space that stands at a text's edge joins nothing of the next text, but may join more white space.
    cut[starts] = True
    cut[len(b)] = False
    return np.flatnonzero(cut)


class Encoder:
    """Encodes texts piece by piece and keeps what it has encoded; equal to encoding each whole text."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        if sys.byteorder != "little":
            raise ValueError("needs a little-endian machine")
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids whose piece starts with a space
        self.opens[[i for t, i in vocabulary.items() if t[0] == _SPACE]] = True

    def _learn(self, pieces: list[str]) -> None:
        """New pieces: words with a space before them are encoded many at a time, each one being a pre-token."""
        words = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        for i in range(0, len(words), _JOINED):
            part = words[i : i + _JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(part):
                continue
            raw, at = ids.tobytes(), (np.r_[at, len(ids)] * self.dtype.itemsize).tolist()
            self.known.update(zip(part, (raw[a:b] for a, b in zip(at, at[1:], strict=False)), strict=True))
        for p in pieces:
            if p not in self.known:
                self.known[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, self.dtype).tobytes()

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, `end` after each text, and the number of ids of each text (nulls count as empty)."""
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        b = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        raw = b.tobytes()
        whole = [s.encode() in raw for s in self.special]
        starts = np.unique(offsets[:-1][np.diff(offsets) > 0])
        at = starts if any(whole) else cuts(b, starts)
        pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.r_[at, len(b)]), pa.py_buffer(raw)).dictionary_encode()
        names = pieces.dictionary.to_pylist()
        if len(self.known) > MAX_LEARNED:
            self.known.clear()
        self._learn([p for p in names if p not in self.known])
        ids = [*map(self.known.__getitem__, names), np.array([end], self.dtype).tobytes()]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        values = pa.array(np.frombuffer(b"".join(ids), self.dtype))
        first = np.searchsorted(at, offsets)  # a text's first piece
        order = np.insert(pieces.indices.to_numpy().astype(np.int64), first[1:], len(names))
        lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)]), values)
        ends = np.cumsum(size[order])[first[1:] + np.arange(len(texts))]
        return lists.take(pa.array(order)).values.to_numpy(), np.diff(np.r_[0, ends])


def worker_encoder(tokenizer_json: str) -> Encoder:
    """The encoder of this Python worker: its tasks share what it has learned, kept beside the library that made it."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_worker_encoders", {})
    if tokenizer_json not in kept:
        kept[tokenizer_json] = Encoder(tokenizer_json)
    return kept[tokenizer_json]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks."""
    r = ranks.astype("<u4")
    size = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    width = 1
    while width < 4 and len(r) and r.max() >> (8 * width):
        size[: len(r)] += r >= 1 << (8 * width)
        width += 1
    bits = size.reshape(-1, 4)
    control = bits[:, 0] | (bits[:, 1] << 2) | (bits[:, 2] << 4) | (bits[:, 3] << 6)
    low = r.view(np.uint8).reshape(-1, 4)[:, :width]
    return control.tobytes(), low[np.arange(width) <= size[: len(r), None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Ranks from control and data bytes, by table lookup of the lengths."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    width = int(size.max()) if n else 1
    out = np.zeros((n, width), np.uint8)
    out[np.arange(width) < size[:, None]] = np.frombuffer(data, np.uint8)
    ranks = np.zeros((n, 4), np.uint8)
    ranks[:, :width] = out
    return ranks.view("<u4").ravel()


def block_bytes(ids: list[int], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    return b"".join([MAGIC, struct.pack("<QQ", len(ids), len(ranks)), np.array(ids, "<i8").tobytes(), np.array(counts, "<i8").tobytes(), control, data])


def read_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, counts and ranks of a block."""
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    n, m = struct.unpack_from("<QQ", block, 4)
    ids, counts = np.frombuffer(block, "<i8", n, 20), np.frombuffer(block, "<i8", n, 20 + 8 * n)
    at = 20 + 16 * n
    return ids, counts, unpack(block[at : at + -(-m // 4)], block[at + -(-m // 4) :], m)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about SLICE_BYTES of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES)))
        yield batch.slice(at, to - at)
        at = to


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every whole text, append `end_id`, and write the format; returns the folder.

    Null texts count as empty (the end id alone). Rows come in ascending id order; rows that repeat an id
    all come, in order of their number of ids, then of their compressed ids; rows without an id are left
    out, as the format stores ids. Other columns are ignored. An empty table writes no blocks. The
    tokenizer's file is read by the driver and sent to the tasks.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tallyfold/tokens-{uuid.uuid4().hex}"
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "ids", "counts"]
        squeeze = zstandard.ZstdCompressor(1).compress
        encoder = worker_encoder(model.value)
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for part in _slices(b, 1):
                ids, n = encoder(part.column(1), end_id)
                seen = np.bincount(ids)
                if len(seen) > len(total):
                    total = np.r_[total, np.zeros(len(seen) - len(total), np.int64)]
                total[: len(seen)] += seen
                raw, to = memoryview(ids).cast("B"), (np.cumsum(n) * ids.itemsize).tolist()
                packed = [squeeze(raw[i:j]) for i, j in zip([0, *to], to, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(packed, pa.binary()), pa.nulls(len(packed), pa.binary())], names=names)
        used = np.flatnonzero(total)
        if len(used):  # a task's counts stand in a column of their own, read without the ids
            counts = np.c_[used, total[used]].astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts])], names=names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                pairs = np.frombuffer(x, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["id", "n"])

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encoded = staged(texts.mapInArrow(encode, "doc_id long, n long, ids binary, counts binary"), "ids", compression="uncompressed")
    counts = encoded.select("counts").where("counts is not null").mapInArrow(spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row per id of the vocabulary
    ranks = [r[0] for r in sorted(counts, key=lambda r: (-r[1], r[0]))]
    spark.createDataFrame([(i, x) for i, x in enumerate(ranks)], "rank int, id long").coalesce(1).write.parquet(f"{path}/ranks")
    table = np.zeros(1 + max(ranks, default=0), np.uint32)
    table[ranks] = np.arange(len(ranks), dtype=np.uint32)
    shards = max(1, -(-sum(r[1] for r in counts) // SHARD_IDS))
    wide = np.dtype("<u2" if model_fits(model.value) else "<u4")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsqueeze = zstandard.ZstdDecompressor().decompress
        ids, ns, held, size, start, shard, k = [], [], [], 0, 0, -1, 0

        def row() -> pa.RecordBatch:
            block = block_bytes(ids, ns, table[np.frombuffer(b"".join(held), wide)])
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([k], pa.int64()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([block], pa.binary())], names=["shard", "block", "start", "n", "bytes"])

        for b in batches:
            for s, doc, n, x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                shard = s
                if ids and size + n > BLOCK_IDS:
                    yield row()
                    ids, ns, held, size, start, k = [], [], [], 0, start + size, k + 1
                ids.append(doc)
                ns.append(n)
                held.append(unsqueeze(x))
                size += n
        if ids:
            yield row()

    dealt = encoded.where("doc_id is not null").select("doc_id", "n", "ids").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "n", "ids")
    out = dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "n", "ids").mapInArrow(blocks, "shard int, block long, start long, n long, bytes binary")
    out.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


def model_fits(tokenizer_json: str) -> bool:
    """Whether the model's ids fit two bytes."""
    return worker_encoder(tokenizer_json).dtype.itemsize == 2


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian uint32) of each document, from the files alone."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").collect()  # one row per id of the vocabulary
    table = np.zeros(len(ranks), "<u4")
    for r in ranks:
        table[r[0]] = r[1]
    sizes = {r[0]: r[1] for r in blocks.groupBy("shard").agg(F.sum("n")).collect()}  # one row per shard of 16M ids
    before, bases = 0, {}
    for shard in sorted(sizes):
        bases[shard] = before
        before += sizes[shard]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard, start = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                ids, counts, ranks = read_block(b.column(2)[i].as_py())
                starts = np.r_[0, np.cumsum(counts)]
                if starts[-1] < 1 << 29:
                    raw = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((starts * 4).astype(np.int32)), pa.py_buffer(table[ranks])])
                else:  # a single text of over 2 GB of ids
                    raw = pa.array([table[ranks].tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(bases[shard] + start + starts[:-1]), pa.array(counts), raw], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("shard", "start", "bytes").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
