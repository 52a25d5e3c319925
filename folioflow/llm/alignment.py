"""Operator 12: alignment of two tokenizers over all texts, by a sweep over the ends of their tokens.

Tokenizer A is a byte-level vocabulary, B a sentencepiece model; both encode the text with one blank before it, so
their tokens are two ways of cutting the same bytes. The end of every token is an event. Events travel in runs:
the first byte, the side, and the ids, whose byte lengths give the ends. Runs of both sides are one table, dealt by
document, sorted by offset within partitions, and streamed through a machine that holds the tokens after the last
common end and a running digest, whatever the length of a document. Where A and B both end, a group ends, and
the two tokens that end there are linked (no token is empty, so there is one such pair at each common end).

How often an id pair is linked is counted over the corpus: sums per task, then by pair; the highest count of a B
id is taken over at most as many pairs as A has ids. The pairs most often linked, ``TABLE`` at most, chosen by a histogram of
counts, go to every executor; links of other pairs, summed by document, are joined. The result is the same
wherever that line runs.

Defined results: a null or empty text, and one that the tokens' bytes do not give back (it holds the model's own sign
of a blank), has no tokens: zeros and an empty digest. Equal texts give equal values, and every row counts:
a repeated row links its pairs again. A null doc_id stays; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import binary_array, chunks, materialise, ragged
from folioflow.llm.vocabularies import PlainEncoder, SentenceEncoder, kept

#: Ids in a run of events, bytes of ids swept at once, pairs in the broadcast table, distinct pairs that a task holds.
RUN, SWEPT, TABLE, HELD = 4096, 2 << 20, 1 << 18, 1 << 20
#: A link is the id of A times 2^16 and the id of B.
SHIFT = 16
A, B = 0, 1
EVENTS = "key long, doc_id {}, side int, start long, ids binary"
ALIGNED = "key long, doc_id {}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def events(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Runs of end events of both sides, and at least one of A for every row of ``docs`` (doc_id, text); ``key`` tells rows apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = kept(PlainEncoder, path_a), kept(SentenceEncoder, path_b)
        lengths = [e.byte_lengths() for e in encoders]
        key = TaskContext.get().partitionId() << 36
        for batch in chunks(batches, "text"):
            texts = batch.column("text").fill_null("").to_pylist()
            begun = [" " + t if t else "" for t in texts]
            sizes = np.fromiter((len(t.encode()) for t in begun), dtype=np.int64, count=len(begun))
            found, right = [], np.ones(len(texts), dtype=bool)
            for encoder, length in zip(encoders, lengths, strict=True):
                ids, bounds = encoder._encode_plain(begun)
                ends = np.concatenate([[0], np.cumsum(length[ids])])
                right &= ends[bounds[1:]] - ends[bounds[:-1]] == sizes
                found.append((ids.astype("<u2"), bounds, ends))
            for side, (ids, bounds, ends) in enumerate(found):
                count = np.where(right, np.diff(bounds), 0)
                runs = np.maximum(-(-count // RUN), side == A)
                row = np.repeat(np.arange(len(texts)), runs)
                at = ragged(np.zeros(len(texts), dtype=np.int64), runs) * RUN
                first = bounds[row] + at
                size = np.minimum(RUN, count[row] - at)
                data = binary_array(ids[ragged(first, size)], np.concatenate([[0], np.cumsum(size)]))
                columns = [pa.array(key + row), batch.column("doc_id").take(pa.array(row)), pa.array(np.full(len(row), side, dtype=np.int32)), pa.array(ends[first] - ends[bounds[row]]), data]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "side", "start", "ids"])
            key += len(texts)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(task, EVENTS.format(kind))


@dataclass
class Open:
    """What the machine holds of a document that goes on: its tokens after the last common end, counts and digest so far."""

    key: int | None = None
    doc_id: object = None
    ids: list = field(default_factory=lambda: [np.zeros(0, dtype=np.int64)] * 2)
    start: list = field(default_factory=lambda: [0, 0])
    counts: list = field(default_factory=lambda: [0, 0, 0])
    digest: object = None


class Sweep:
    """The machine: runs of events in, rows of documents out."""

    def __init__(self, lengths_a: np.ndarray, lengths_b: np.ndarray):
        self.lengths = lengths_a, lengths_b
        self.open = Open()
        most = max(len(lengths_a), len(lengths_b))
        numbers = np.arange(most)
        self.figures = np.stack([numbers // 10**p % 10 for p in (4, 3, 2, 1, 0)], axis=1).astype(np.uint8) + ord("0")
        self.width = np.maximum(1, (numbers[:, None] >= 10 ** np.arange(5)).sum(axis=1))

    def _side(self, side: int, key: np.ndarray, sides: np.ndarray, start: np.ndarray, bounds: np.ndarray, ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a side, the number of each one's document, and its end; what was left open comes first."""
        rows = np.flatnonzero(sides == side)
        counts = np.diff(bounds)[rows]
        at = ragged(bounds[rows], counts)
        left = self.open.ids[side]
        every = np.concatenate([left, ids[at]])
        owner = np.concatenate([np.zeros(len(left), dtype=np.int64), np.repeat(group[rows], counts)])
        begin = np.concatenate([np.full(min(len(left), 1), self.open.start[side]), start[rows]])
        counts = np.concatenate([np.full(min(len(left), 1), len(left)), counts])
        sums = np.concatenate([[0], np.cumsum(self.lengths[side][every])])
        first = np.cumsum(counts) - counts
        return every, owner, sums[1:] + np.repeat(begin - sums[first], counts)

    def _text(self, a: np.ndarray, b: np.ndarray, hit_a: np.ndarray, hit_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of groups "a,a|b,b;", and where each group's end in them."""
        before_a, before_b = np.cumsum(hit_a) - hit_a, np.cumsum(hit_b) - hit_b
        ends_a, ends_b = np.flatnonzero(hit_a) + 1, np.flatnonzero(hit_b) + 1
        place_a = np.arange(len(a)) + np.concatenate([[0], ends_b])[before_a]
        place_b = np.arange(len(b)) + ends_a[before_b]
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[place_a], order[place_b] = a, b
        sign = np.full(len(order), ord(","), dtype=np.uint8)
        sign[place_a[hit_a]], sign[place_b[hit_b]] = ord("|"), ord(";")
        cells = np.column_stack([self.figures[order], sign])
        shown = np.arange(6) >= 5 - self.width[order][:, None]
        ends = np.cumsum(self.width[order] + 1)
        return cells[shown], ends[place_b[hit_b]]

    def feed(self, batch: pa.RecordBatch, last: bool) -> pa.RecordBatch | None:
        """Rows of all documents of the batch but the last, which may go on unless ``last``; of it, the links found so far."""
        key, sides, start = (np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "side", "start"))
        column = batch.column("ids")
        bounds = np.asarray(pa.compute.binary_length(column), dtype=np.int64) // 2
        bounds = np.concatenate([[0], np.cumsum(bounds)])
        ids = np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").astype(np.int64)
        new = np.diff(key, prepend=-1 if self.open.key is None else self.open.key) != 0
        group = np.cumsum(new)  # 0 is the open document
        which = np.flatnonzero(new)
        docs = 1 + len(which)
        tokens = [self._side(side, key, sides, start, bounds, ids, group) for side in (A, B)]
        places = [owner << 40 | end for _, owner, end in tokens]
        common = np.intersect1d(*places, assume_unique=True)
        hits = [np.zeros(len(p), dtype=bool) for p in places]
        for hit, place in zip(hits, places, strict=True):
            hit[np.searchsorted(place, common)] = True
        done = [np.flatnonzero(hit)[-1] + 1 if hit.any() else 0 for hit in hits]
        # Tokens after the last common end stay open; whole documents have none, since both sides end where the text does.
        (a, owner_a, end_a), (b, owner_b, end_b) = tokens
        data, ends = self._text(a[: done[A]], b[: done[B]], hits[A][: done[A]], hits[B][: done[B]])
        groups_of = common >> 40
        links = (a[hits[A]] << SHIFT | b[hits[B]]).astype("<u4")
        cuts = np.searchsorted(groups_of, np.arange(docs + 1))
        edges = np.concatenate([[0], ends])[cuts]
        counts = [np.bincount(owner_a[: done[A]], minlength=docs), np.bincount(owner_b[: done[B]], minlength=docs), np.diff(cuts)]
        keys = [self.open.key, *key[which].tolist()]
        names = [self.open.doc_id, *batch.column("doc_id").take(pa.array(which)).to_pylist()]
        rows, state = [], self.open
        for k in range(docs):
            if k:
                state = Open(keys[k], names[k], counts=[0, 0, 0])
            if edges[k + 1] > edges[k]:
                piece = data[edges[k] : edges[k + 1] - 1].tobytes()
                if state.digest is None:
                    state.digest = hashlib.sha256(piece)
                else:
                    state.digest.update(b";" + piece)
            state.counts = [x + int(c[k]) for x, c in zip(state.counts, counts, strict=True)]
            whole = k < docs - 1 or last
            shown = [*state.counts, state.digest.hexdigest() if state.digest else ""] if whole else [None] * 4
            rows.append((state.key, state.doc_id, *shown))
        if not last:
            state.ids = [a[done[A] :], b[done[B] :]]
            state.start = [int(e[n] - self.lengths[s][t[n]]) if n < len(t) else 0 for s, (t, _, e), n in zip((A, B), tokens, done, strict=True)]
        self.open = Open() if last else state
        begin = int(keys[0] is None)  # before the first document nothing is open
        columns = list(zip(*rows[begin:], strict=True)) or [[]] * 6
        kinds = [pa.int64(), batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, binary_array(links, cuts[begin:])], names=[x.split()[0] for x in ALIGNED.split(", ")])


def aligned(docs: DataFrame, path_a: str, path_b: str, swept: int = SWEPT) -> DataFrame:
    """Counts, digest and links of every row of ``docs``. A long document's links may come in several rows of one key; one of them has the counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Sweep(kept(PlainEncoder, path_a).byte_lengths(), kept(SentenceEncoder, path_b).byte_lengths())
        held = None
        for batch in chunks(batches, "ids", swept):
            if held is not None:
                yield machine.feed(held, False)
            held = batch
        if held is not None:
            yield machine.feed(held, True)

    dealt = events(docs, path_a, path_b).repartition("key").sortWithinPartitions("key", "start", "side")
    return dealt.mapInArrow(task, ALIGNED.format(kind))


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best) of all id pairs linked in ``links`` (links): how often, and whether no other pair of the same B id is linked more often."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        for batch in chunks(batches, "links", 16 << 20):
            new, n = np.unique(np.frombuffer(b"".join(batch.column("links").to_pylist()), dtype="<u4"), return_counts=True)
            pairs, which = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            counts = np.bincount(which, weights=np.concatenate([counts, n]), minlength=len(pairs)).astype(np.int64)
            if len(pairs) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], names=["pair", "n"])
                pairs, counts = pairs[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

    sums = links.select("links").mapInArrow(task, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    same_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << SHIFT) - 1))
    return sums.withColumn("best", F.col("n") == F.max("n").over(same_b))


def frequent_pairs(pairs: DataFrame, most: int = TABLE) -> tuple[DataFrame, bool]:
    """The pairs linked most often, ``most`` at most, and whether they are all. Whole classes of counts are taken, eight to a power of two."""
    size = F.floor(F.log2("n") * 8)
    classes = sorted((r["size"], r["pairs"]) for r in pairs.groupBy(size.alias("size")).agg(F.count("*").alias("pairs")).collect())
    least, total = None, 0
    for number, count in reversed(classes):
        if total + count > most:
            break
        least, total = number, total + count
    whole = total == sum(c for _, c in classes)
    return (pairs if whole else pairs.filter(size >= least) if least is not None else pairs.limit(0)), whole


def align(docs: DataFrame, path_a: str, path_b: str, most: int = TABLE, swept: int = SWEPT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs`` (doc_id, text)."""
    rows = materialise(aligned(docs, path_a, path_b, swept), "aligned")
    pairs = materialise(pair_counts(rows), "pairs")
    top, whole = frequent_pairs(pairs, most)
    known = top.orderBy("pair").toArrow()
    table = tuple(np.asarray(known.column(c)) for c in ("pair", "n", "best"))
    shared = docs.sparkSession.sparkContext.broadcast((table[0].astype("<u4"), table[1], table[2].astype(np.int64)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the links of known pairs (pair null), and how often each other pair is linked."""
        pairs, counts, best = shared.value
        for batch in chunks(batches, "links", 4 << 20):
            column = batch.column("links")
            sizes = np.asarray(pa.compute.binary_length(column), dtype=np.int64) // 4
            links = np.frombuffer(b"".join(column.to_pylist()), dtype="<u4")
            at = np.minimum(np.searchsorted(pairs, links), max(len(pairs) - 1, 0))
            there = pairs[at] == links if len(pairs) else np.zeros(len(links), dtype=bool)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sums = [np.concatenate([[0], np.cumsum(np.where(there, of[at], 0) if len(pairs) else np.zeros(len(links), dtype=np.int64))]) for of in (best, counts)]
            key = np.asarray(batch.column("key"))
            missed = np.flatnonzero(~there)
            rest, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[missed] << 32 | links[missed].astype(np.int64), return_counts=True)
            n = len(key)
            columns = [
                pa.array(np.concatenate([key, key[rest >> 32]])),
                pa.array(np.concatenate([np.zeros(n, dtype=np.int64), rest & 0xFFFFFFFF]), mask=np.arange(n + len(rest)) < n),
                pa.array(np.concatenate([sums[0][ends[1:]] - sums[0][ends[:-1]], times])),
                pa.array(np.concatenate([sums[1][ends[1:]] - sums[1][ends[:-1]], times])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "pair", "n_best", "count_sum"])

    found = rows.select("key", "links").mapInArrow(task, "key long, pair long, n_best long, count_sum long")
    sums = found if whole else materialise(found, "sums")
    parts = sums.filter("pair is null").select("key", "n_best", "count_sum")
    if not whole:
        rare = sums.filter("pair is not null").join(pairs, "pair")
        parts = parts.unionByName(rare.select("key", F.when(F.col("best"), F.col("n_best")).otherwise(0).alias("n_best"), (F.col("count_sum") * F.col("n")).alias("count_sum")))
    own = rows.select("key", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    every = own.unionByName(parts, allowMissingColumns=True).groupBy("key")
    out = every.agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_best", "count_sum")], F.max("groups_sha256").alias("groups_sha256"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
