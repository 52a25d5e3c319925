"""Operator 11: tokens of every text, by lookup of its pre-tokens in two tiers.

A vocabulary encodes a text pre-token by pre-token, so the number of its tokens is the sum over its
pre-tokens. Most of them are among a few thousand frequent ones:

1. Every task keeps a summary of the most frequent pre-tokens of its texts (``SUMMARY`` counters at most, by
   Misra and Gries: each pre-token with more than one in ``SUMMARY`` occurrences is in it), over all texts. Summaries,
   a row each, are merged up a tree; no pre-token is shuffled.
2. The lengths of the most frequent go to every executor as a hash table of ``PLACES`` places, 1.5 MB at any size of the
   input. What is not in it is encoded by the library and remembered in the worker's own table of bounded size.

The first tier decides what is fast, never what is counted: all counts are the library's.

Defined results: a null or empty text has 0 bytes and 0 tokens; equal texts give equal values; a null doc_id stays and
repeated rows stay; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.bytebpe import PieceEncoder
from folioflow.llm.common import chunks, materialise
from folioflow.llm.vocabularies import BLANK, Cut, SentenceEncoder, cut, encoder_for

#: Counters of a summary, pre-tokens of the first tier, places of its hash table, summaries merged at once.
SUMMARY, FREQUENT, PLACES, FAN = 1 << 14, 1 << 15, 1 << 17, 32
LIMIT = 2048
SKETCH = "node long, keys binary, counts binary, pieces array<string>"


def _parts(encoder: PieceEncoder, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The texts cut at added tokens: plain parts, how many each text has, and how many tokens each text has besides."""
    parts, besides = [[t] for t in texts], np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        if isinstance(encoder, SentenceEncoder):  # whose own sign of a blank, inside a text, joins what is cut otherwise
            odd = BLANK in text
            parts[k], besides[k] = [" " + text if text and not odd else ""], len(encoder.library.encode(text)) if odd else 0
        elif encoder.marks is not None and encoder.marks.search(text):
            if encoder.literal:
                found = encoder.marks.split(text)
                parts[k], besides[k] = found[::2], len(found) // 2
            else:
                parts[k], besides[k] = [""], len(encoder.library.encode(text, add_special_tokens=False).ids)
    return list(chain.from_iterable(parts)), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)), besides


class Summary:
    """Counters of the most frequent pre-tokens, ``size`` at most."""

    def __init__(self, size: int):
        self.size = size
        self.keys, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.pieces = np.zeros(0, dtype=object)

    def add(self, keys: np.ndarray, counts: np.ndarray, strings) -> None:
        """Counts of distinct keys; ``strings`` gives the pre-tokens at given places of them."""
        every, where, which = np.unique(np.concatenate([self.keys, keys]), return_index=True, return_inverse=True)
        total = np.bincount(which, weights=np.concatenate([self.counts, counts]), minlength=len(every)).astype(np.int64)
        if len(every) > self.size:  # as many occurrences of as many other pre-tokens go with those of each that stays
            total -= np.partition(total, len(total) - self.size - 1)[len(total) - self.size - 1]
        stay = total > 0
        every, where, total = every[stay], where[stay], total[stay]
        old = where < len(self.keys)
        pieces = np.empty(len(every), dtype=object)
        pieces[old] = self.pieces[where[old]]
        pieces[~old] = strings(where[~old] - len(self.keys))
        self.keys, self.counts, self.pieces = every, total, pieces

    def batch(self, node: int) -> pa.RecordBatch:
        row = [pa.array([node]), pa.array([self.keys.tobytes()]), pa.array([self.counts.tobytes()]), pa.array([self.pieces.tolist()], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(row, names=["node", "keys", "counts", "pieces"])


def merged(rows: list[tuple[bytes, bytes, list[str]]], size: int) -> Summary:
    out = Summary(size)
    for keys, counts, pieces in rows:
        strings = np.array([*pieces, None], dtype=object)[:-1]
        out.add(np.frombuffer(keys, dtype=np.uint64), np.frombuffer(counts, dtype=np.int64), lambda at, strings=strings: strings[at])
    return out


def frequent(texts: DataFrame, path: str, size: int = SUMMARY) -> Summary:
    """The most frequent pre-tokens of all ``texts`` (text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held = encoder_for(path), Summary(size)
        for batch in chunks(batches, "text"):
            parts, _, _ = _parts(encoder, batch.column("text").fill_null("").to_pylist())
            found: Cut = cut(encoder, parts)
            keys, where, counts = np.unique(found.keys, return_index=True, return_counts=True)
            held.add(keys, counts, lambda at, found=found, where=where: found.strings(where[at]))
        if len(held.keys):
            yield held.batch(TaskContext.get().partitionId())

    def merge(table: pa.Table) -> pa.Table:
        rows = zip(*(table.column(c).to_pylist() for c in ("keys", "counts", "pieces")), strict=True)
        return pa.Table.from_batches([merged(list(rows), size).batch(table.column("node")[0].as_py() // FAN)])

    found = materialise(texts.select(F.col("text").cast("string").alias("text")).mapInArrow(task, SKETCH), "summaries")
    while found.count() > 1:
        found = materialise(found.groupBy(F.floor(F.col("node") / FAN)).applyInArrow(merge, SKETCH), "summaries")
    return merged([(bytes(r["keys"]), bytes(r["counts"]), r["pieces"]) for r in found.collect()], size)


class Tiers:
    """Lengths of pre-tokens in tokens: a hash table with two places for each key, and the encoder's own table beyond it."""

    def __init__(self, summary: Summary, lengths: np.ndarray, most: int = FREQUENT, places: int = PLACES):
        order = np.argsort(-summary.counts, kind="stable")[:most]
        self.keys, self.lengths = np.zeros(places, dtype=np.uint64), np.zeros(places, dtype=np.int32)
        for place in self._places(summary.keys):
            order = order[self.keys[place[order]] == 0]
            _, first = np.unique(place[order], return_index=True)  # the most frequent of those that meet
            at = order[first]
            self.keys[place[at]], self.lengths[place[at]] = summary.keys[at], lengths[at]
            order = np.delete(order, first)

    def _places(self, keys: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(len(self.keys) - 1)
        return [(keys & mask).astype(np.int64), ((keys >> np.uint64(40)) & mask).astype(np.int64)]

    def __call__(self, found: Cut, encoder: PieceEncoder) -> np.ndarray:
        """Tokens of every piece of ``found``."""
        out, missed = np.zeros(len(found.keys), dtype=np.int64), np.arange(len(found.keys))
        for place in self._places(found.keys):
            place = place[missed]
            hit = (self.keys[place] == found.keys[missed]) & (found.keys[missed] != 0)
            out[missed[hit]] = self.lengths[place[hit]]
            missed = missed[~hit]
        if len(missed):
            distinct, where, which = np.unique(found.keys[missed], return_index=True, return_inverse=True)
            slots = encoder._slots(distinct, missed[where], found.begin, found.stop, found.joined)
            out[missed] = encoder.counts[slots][which]
        return out


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, size: int = SUMMARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (doc_id, text), by the vocabulary at ``path``."""
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    summary, encoder = frequent(plain, path, size), encoder_for(path)
    lengths = encoder._encode_pieces(summary.pieces.tolist())[0] if len(summary.keys) else np.zeros(0, dtype=np.int32)
    shared = docs.sparkSession.sparkContext.broadcast(Tiers(summary, lengths))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tiers = encoder_for(path), shared.value
        for batch in chunks(batches, "text"):
            column = batch.column("text").fill_null("")
            parts, each, besides = _parts(encoder, column.to_pylist())
            found = cut(encoder, parts)
            sums = np.concatenate([[0], np.cumsum(tiers(found, encoder))])[found.bounds]
            ends = np.concatenate([[0], np.cumsum(each)])
            tokens = sums[ends[1:]] - sums[ends[:-1]] + besides
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.compute.binary_length(column).cast(pa.int64()), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(task, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
