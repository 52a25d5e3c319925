"""Operator 9: documents as binary token-id files with Elias-Fano document boundaries.

A file holds the concatenated ids of a run of documents in ascending doc_id order, the doc_ids (less the
smallest) and the cumulative document ends, both as Elias-Fano sequences: low bits packed, high bits in
unary, and a sample of every ``SELECT_EVERY``-th one-bit for ``select``. Ends take about 2 + log2(ids per
document) bits a document instead of a 64-bit offset. What reads them finds a document by ``select``; no table of
offsets is ever unpacked.

Files are written by the executors straight to the shared folder, each under a name that depends only
on its partition, through a temporary name and a rename, so a repeated task replaces its own file.

The number of range partitions follows the bytes of text; equal doc_ids (null ones among them) are dealt
on by a hash of the text.

Defined results: a null text counts as empty (the document is its end id alone); equal doc_ids stand
next to each other, ordered by a hash of the text; a null doc_id sorts first; an empty table gives no file and no
row. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import CHUNK_CHARS, chunks, partitions_for, scratch

MAGIC = b"FFEF0002"
#: Ids after which a file is closed at the next document.
FILE_IDS = 16_000_000
SELECT_EVERY = 64
#: Documents described at once when files are read.
ROWS = 10_000
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
_HEADER = struct.Struct("<8sQQIIq")
_EF_HEADER = struct.Struct("<QQIII")


class EliasFano:
    """A non-decreasing sequence of unsigned integers in near-minimal space, with constant-time-like access."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, universe, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SELECT_EVERY].astype("<u4"))

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        data = self.low[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes()
        return int.from_bytes(data, "little") >> (at & 7) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample on, ones are counted byte by byte."""
        bit = int(self.samples[i // SELECT_EVERY])
        left = i % SELECT_EVERY
        byte = bit >> 3
        word = int(self.high[byte]) >> (bit & 7) << (bit & 7)
        while (found := word.bit_count()) <= left:
            left -= found
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = (byte << 3) + (word & -word).bit_length() - 1
        return ((one - i) << self.low_bits) | self._low(i)

    def to_bytes(self) -> bytes:
        head = _EF_HEADER.pack(self.n, self.universe, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    def size(self) -> int:
        """Bytes of ``to_bytes``."""
        return _EF_HEADER.size + len(self.low) + len(self.high) + 4 * len(self.samples)

    @classmethod
    def from_bytes(cls, data: memoryview) -> EliasFano:
        n, universe, low_bits, low, high = _EF_HEADER.unpack_from(data)
        at = _EF_HEADER.size
        parts = np.frombuffer(data, np.uint8, low + high, at)
        return cls(n, universe, low_bits, parts[:low], parts[low:], np.frombuffer(data, "<u4", -(-n // SELECT_EVERY), at + low + high))


class TokenFile:
    """One file, read back: ``ids`` of all its documents; their ``doc_ids`` and ``ends`` as Elias-Fano."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.n_docs, n_ids, width, self.nulls, self.least = _HEADER.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEADER.size
        self.ids = np.frombuffer(view, f"<u{width}", n_ids, at)
        at += n_ids * width
        self.doc_ids = EliasFano.from_bytes(view[at:])
        self.ends = EliasFano.from_bytes(view[at + self.doc_ids.size() :])

    def bounds(self, i: int) -> tuple[int, int]:
        """Where the ids of the i-th document begin and end, found by two selects."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        start, stop = self.bounds(i)
        return self.ids[start:stop]

    def doc_id(self, i: int) -> int | None:
        """The doc_id of the i-th document."""
        return None if i < self.nulls else self.least + self.doc_ids.select(i - self.nulls)


def token_file(ids: np.ndarray, ends: np.ndarray, doc_ids: np.ndarray, nulls: int) -> bytes:
    """The bytes of a file. Null doc_ids come first; ``nulls`` is their number."""
    known = doc_ids[nulls:].astype(np.int64)
    least = int(known[0]) if len(known) else 0
    head = _HEADER.pack(MAGIC, len(ends), len(ids), ids.dtype.itemsize, nulls, least)
    return head + ids.tobytes() + EliasFano.encode(known.view(np.uint64) - np.int64(least).view(np.uint64)).to_bytes() + EliasFano.encode(ends).to_bytes()


def _write(uri: str, data: bytes, attempt: int) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{attempt}.tmp"
    with store.open_output_stream(temporary) as out:
        out.write(data)
    store.move(temporary, path)


def _read(uri: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as stream:
        return stream.read()


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str, file_ids: int = FILE_IDS) -> list[tuple[str, int, int]]:
    """Encode ``docs`` (doc_id, text) and write the files. Returns (path, documents, ids) by file, in doc_id order.

    The list has an entry per file of ``file_ids`` ids, so it is millions of times smaller than the ids.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from folioflow.llm.bytebpe import encoder

        context = TaskContext.get()
        made, ids, lengths, keys, nulls, held = [], [], [], [], 0, 0

        def close() -> None:
            nonlocal held, nulls
            uri = f"{folder}/part-{context.partitionId():06d}-{len(made):05d}.tokens"
            flat, ends = np.concatenate(ids), np.cumsum(np.concatenate(lengths))
            _write(uri, token_file(flat, ends, np.concatenate(keys), nulls), context.taskAttemptId())
            made.append((context.partitionId(), len(made), uri, len(ends), len(flat)))
            for part in (ids, lengths, keys):
                part.clear()
            held = nulls = 0

        bpe = encoder(vocabulary)
        for batch in chunks(batches, "text", min(CHUNK_CHARS, file_ids)):
            found, bounds = bpe.encode(batch.column("text").to_pylist())
            closed = np.insert(found, bounds[1:], end_id).astype(found.dtype)
            column = batch.column("doc_id")
            ids.append(closed)
            lengths.append(np.diff(bounds) + 1)
            keys.append(np.asarray(pa.compute.fill_null(column, 0), dtype=np.int64))
            nulls += column.null_count
            held += len(closed)
            if held >= file_ids:
                close()
        if held:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "number", "path", "docs", "ids"), x, strict=True)) for x in made], schema=pa.schema([("part", pa.int64()), ("number", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    count = partitions_for(ordered.agg(F.sum(F.octet_length("text"))).first()[0], docs.sparkSession)
    ordered = ordered.repartitionByRange(count, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = ordered.mapInArrow(task, "part long, number long, path string, docs long, ids long").collect()
    return [(f.path, f.docs, f.ids) for f in sorted(files)]


def read_token_files(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and ids_crc32, all taken from the stored bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(_read(path))
                for at in range(0, file.n_docs, ROWS):
                    rows = []
                    for i in range(at, min(at + ROWS, file.n_docs)):
                        start, stop = file.bounds(i)
                        rows.append((file.doc_id(i), base + start, stop - start, zlib.crc32(file.ids[start:stop].astype("<u4").tobytes())))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    bases = np.concatenate(([0], np.cumsum([ids for _, _, ids in files]))).tolist()
    rows = [(path, base) for (path, _, _), base in zip(files, bases, strict=False)]
    listed = spark.createDataFrame(rows, "path string, base long")
    if len(rows) > 1:
        listed = listed.repartitionByRange(min(len(rows), 10_000), "base")
    return listed.mapInArrow(task, RESULT)


def encode_to_files(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token files below ``folder`` (shared scratch by default) and describe them from the files."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, vocabulary, end_id, folder or scratch(spark, "tokens")))
