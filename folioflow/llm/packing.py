"""Operator 7: packing documents into fixed-length sequences along a space-filling curve.

Each document's ids give a hashed vector: every token id has a fixed pseudo-random direction, and the
mean direction is projected to ``DIMENSIONS`` numbers. Scaled to a grid, these give a place on a Hilbert
curve. Documents are range-sorted by that place and laid end to end, so a sequence holds documents with
similar words. Cuts are free: a sequence is filled to its last token. What is left at the end of a range
partition is cut into sequences whose lengths are powers of two, so nothing is padded.

The key is followed by doc_id in the sort, so a large group of equal texts, which share one place on the
curve, is dealt over as many partitions as its size asks for. The encoded table is written to the shared
folder once: the range bounds, the shuffle and a repeated task read it from there.

Defined results: a null or empty text is its end id alone; equal rows are packed one after the other;
a null doc_id sorts first; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import binary_array, chunks, materialise, partitions_for

DIMENSIONS = 4
#: Bits of the grid in each dimension.
GRID_BITS = 12
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def directions(size: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A fixed pseudo-random direction for every token id: float32 of (size, dimensions), roughly normal."""
    x = np.arange(size * dimensions, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(size * dimensions)
    for _ in range(4):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        total += (x >> np.uint64(11)).astype(np.float64) / 2**53 - 0.5
    return (total * 3**0.5).reshape(size, dimensions).astype(np.float32)


def hilbert_key(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of grid points (n, d) of ``bits`` bits: Gray-code untangling, then interleaved bits."""
    x = grid.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            inverted = (x[i] & q) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        fix ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= fix
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_places(ids: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The curve place of each run of ids; ``bounds`` has one entry more than there are runs, all runs non-empty."""
    lengths = np.diff(bounds)
    means = np.stack([np.add.reduceat(table[:, k][ids], bounds[:-1], dtype=np.float64) for k in range(table.shape[1])], axis=1) / lengths[:, None]
    # The deviation of a mean of n directions shrinks with n; this spreads short and long documents over the grid alike.
    spread = means * np.sqrt(np.minimum(lengths, 256))[:, None]
    scaled = 1 / (1 + np.exp(-1.7 * spread))
    return hilbert_key(np.minimum((scaled * (1 << GRID_BITS)).astype(np.int64), (1 << GRID_BITS) - 1), GRID_BITS)


def encode(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, place, n and ids (little-endian, as narrow as the vocabulary allows, end id included) of every document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from folioflow.llm.bytebpe import encoder

        bpe = encoder(vocabulary)
        table = directions(bpe.library.get_vocab_size())
        for batch in chunks(batches, "text"):
            found, bounds = bpe.encode(batch.column("text").to_pylist())
            ids = np.insert(found, bounds[1:], end_id).astype(found.dtype)
            bounds = bounds + np.arange(len(bounds))
            place = curve_places(ids, bounds, table)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(place), pa.array(np.diff(bounds)), binary_array(ids, bounds), pa.array(np.full(len(place), ids.dtype.itemsize, dtype=np.int32))], names=["doc_id", "place", "n", "ids", "width"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(task, "doc_id long, place long, n long, ids binary, width int")


def power_of_two_sizes(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Lays documents end to end into sequences; ``rows`` collects finished pieces."""

    def __init__(self, first_sequence: int, length: int):
        self.sequence, self.length, self.used = first_sequence, length, 0
        self.open: list[tuple] = []  # (doc_id, start, ids, doc_tokens) in the sequence not yet full
        self.rows: list[tuple] = []

    def _close(self) -> None:
        offset = 0
        for doc_id, start, ids, total in self.open:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.open, self.used, self.sequence = [], 0, self.sequence + 1

    def _fill(self, pieces: list[tuple], length: int) -> None:
        for doc_id, start, ids, total in pieces:
            at = 0
            while at < len(ids):
                part = ids[at : at + length - self.used]
                self.open.append((doc_id, start + at, part, total))
                self.used += len(part)
                at += len(part)
                if self.used == length:
                    self._close()

    def add(self, doc_id, ids: np.ndarray) -> None:
        self._fill([(doc_id, 0, ids, len(ids))], self.length)

    def finish(self) -> None:
        """Cut what is open into sequences of powers of two."""
        left = self.open
        total, self.open, self.used = self.used, [], 0
        for size in power_of_two_sizes(total):
            took, need, rest = [], size, []
            for doc_id, start, ids, n in left:
                part = ids[:need]
                if len(part):
                    took.append((doc_id, start, part, n))
                if len(part) < len(ids):
                    rest.append((doc_id, start + len(part), ids[len(part) :], n))
                need -= len(part)
            self._fill(took, size)
            left = rest

    def batch(self) -> pa.RecordBatch:
        names = [f.split()[0] for f in RESULT.split(", ")]
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(encoded: DataFrame, length: int = 2048) -> DataFrame:
    """Pieces of the encoded documents in sequences of at most ``length`` ids, by curve order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId() << 40, length)
        for batch in batches:
            widths = batch.column("width").to_pylist()
            for doc_id, data, width in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), widths, strict=True):
                packer.add(doc_id, np.frombuffer(data.as_buffer(), f"<u{width}"))
            yield packer.batch()
        packer.finish()
        yield packer.batch()

    count = partitions_for(encoded.agg(F.sum(F.col("n") * F.col("width"))).first()[0], encoded.sparkSession)
    ordered = encoded.repartitionByRange(count, "place", "doc_id").sortWithinPartitions("place", "doc_id", "ids")
    return ordered.mapInArrow(task, RESULT)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and pack them."""
    return pack(materialise(encode(docs, vocabulary, end_id), "encoded"), length)
