r"""Operator 13: phrases of two to five words, mined level by level.

A phrase occurs only where its two parts of one word less occur, so level k needs to look only at places where
both (k-1)-grams are frequent (Apriori). Which ones are goes to every executor as a bitmap of their hashes: at
most ``BITS`` bits (32 MB) however many there are, built by a grouped aggregate. A hash that meets another one's bit
lets a rare phrase be counted in vain; the count, which is exact and by the phrase itself, drops it. A task
counts the phrases of a chunk of texts in numpy, Spark sums these counts within the task and then by phrase.

Pairs are by far the most numerous, and most of them are rare: they are first counted by hash alone, 16 bytes a pair, and
only those whose hash is frequent are then counted by themselves.

A candidate is scored at each cut into two parts, whose counts stand in the level tables, since both are at least as
frequent; the lowest score is the candidate's. A candidate that never occurs outside a longer one is dropped.
Arithmetic is in decimals of 38 digits, exact for a*n up to 10^35.

Words are the runs of ``[^\x20\x09]`` within pieces between ``[.,;:!?\x0A-\x0D]``, A-Z lowered. Defined results: a null or
empty text holds no words; a null lang is "und", together with texts of that very lang; repeated rows count as often as they
stand there; ties are broken by frequency, then by the phrase's bytes; an empty table, or one without a frequent
phrase, gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import chunks, materialise, ragged
from folioflow.llm.words import mix64, run_hashes, runs

LONGEST, LEAST, BEST = 5, 100, 2000
#: Bytes of text counted at once; bits of the bitmap at least, at most, and for each gram.
CHUNK = 3_000_000
FEWEST_BITS, BITS, BITS_EACH = 1 << 16, 1 << 28, 64
#: Bits of one row of the aggregate that builds the bitmap, as Spark has it.
ROW_BITS = 8 * 4096
#: Parts of a lang that are ranked apart before they are ranked together.
SHARES = 64
COUNTED = "lang string, phrase string, code long, n long"


class Words:
    """The words of some texts: places in ``data``, their pieces and langs, and 64-bit hashes of runs of them."""

    def __init__(self, texts: list[str], langs: np.ndarray, seeds: np.ndarray):
        data = np.frombuffer(("\n".join(texts) + "\n").encode(), dtype=np.uint8)
        self.data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
        ends = np.isin(data, np.frombuffer(b".,;:!?\n\x0b\x0c\r", dtype=np.uint8))
        self.begin, self.stop = runs(~ends & (data != 0x20) & (data != 0x09))
        self.piece = np.cumsum(ends)[self.begin]
        sizes = np.fromiter((len(t.encode()) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.lang = langs[np.searchsorted(np.cumsum(sizes), self.begin, side="right")]
        self.codes = [mix64(run_hashes(self.data, self.begin, self.stop) ^ seeds[self.lang])]

    def code(self, k: int) -> np.ndarray:
        """Hashes of the runs of k words that begin at each word but the last k-1."""
        while len(self.codes) < k:
            before = self.codes[-1]
            self.codes.append(mix64(before[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.codes[0][len(self.codes) :]) if len(before) > 1 else before[:0])
        return self.codes[k - 1]

    def whole(self, k: int) -> np.ndarray:
        """Does the run of k words that begins there lie in one piece?"""
        n = max(len(self.begin) - k + 1, 0)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]

    def phrases(self, first: np.ndarray, k: int) -> pa.Array:
        """The runs of k words that begin at ``first``, one blank between words."""
        words = (first[:, None] + np.arange(k)).reshape(-1)
        size = self.stop[words] - self.begin[words] + 1
        size[k - 1 :: k] -= 1
        ends = np.cumsum(size)
        out = self.data[ragged(self.begin[words], size)]
        inner = np.ones(len(words), dtype=bool)
        inner[k - 1 :: k] = False
        out[ends[inner] - 1] = 0x20
        bounds = np.concatenate([[0], ends[k - 1 :: k]]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(out)])


def marked(bitmap: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set?"""
    place = codes >> np.uint64(64 - (8 * len(bitmap)).bit_length() + 1)
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def frequent_bits(level: DataFrame, grams: int, most: int = BITS) -> np.ndarray:
    """A bitmap of the hashes of ``level`` (code), whose number is ``grams``; no larger than ``most`` bits."""
    size = min(max(FEWEST_BITS, 1 << (BITS_EACH * grams - 1).bit_length()), most)
    place = F.shiftrightunsigned("code", 64 - size.bit_length() + 1)
    rows = level.groupBy(F.floor(place / ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(place % ROW_BITS).alias("bits"))
    bitmap = np.zeros(size // 8, dtype=np.uint8)
    for r in rows.toLocalIterator():
        part = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        at = r["row"] * (ROW_BITS // 8)
        bitmap[at : at + len(part)] = part
    return bitmap


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, pa.Array]]:
    """The words of some texts at a time, and the langs that their numbers mean."""
    for batch in chunks(batches, "text", CHUNK):
        names = batch.column("lang").dictionary_encode()
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in names.dictionary.to_pylist()], dtype=np.uint64)
        yield Words(batch.column("text").to_pylist(), np.asarray(names.indices), seeds), names.dictionary


def places(words: Words, k: int, bitmap: np.ndarray | None, own: np.ndarray | None = None) -> np.ndarray:
    """Where runs of k words begin whose both runs of one word less are in ``bitmap``, and which are themselves in ``own``; null leaves all."""
    here = words.whole(k)
    if bitmap is not None:
        parts = marked(bitmap, words.code(k - 1))
        here &= parts[: len(here)] & parts[1 : len(here) + 1]
    at = np.flatnonzero(here)
    return at if own is None else at[marked(own, words.code(k)[at])]


def frequent_codes(texts: DataFrame, k: int, least: int, bitmap: np.ndarray | None, most: int = BITS) -> np.ndarray:
    """A bitmap of the hashes that runs of k words have ``least`` times or more together: of all frequent runs, and hardly any other."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _ in _chunks(batches):
            code, n = np.unique(words.code(k)[places(words, k, shared.value)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], names=["code", "n"])

    sums = texts.mapInArrow(task, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    codes = materialise(sums.filter(F.col("n") >= least).select("code"), f"codes-{k}")
    return frequent_bits(codes, codes.count(), most)


def counted(texts: DataFrame, k: int, least: int, bitmap: np.ndarray | None, own: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, code, n) of the runs of k words with ``least`` occurrences or more in ``texts`` (lang, text); at level 1 also the number of words of each lang, phrase null."""
    shared = texts.sparkSession.sparkContext.broadcast((bitmap, own))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs in _chunks(batches):
            at = places(words, k, *shared.value)
            code, first, n = np.unique(words.code(k)[at], return_index=True, return_counts=True)
            first = at[first]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(words.lang[first])), words.phrases(first, k), pa.array(code.view(np.int64)), pa.array(n)], names=["lang", "phrase", "code", "n"])
            if k == 1:
                total, nothing = np.bincount(words.lang, minlength=len(langs)), pa.nulls(len(langs))
                yield pa.RecordBatch.from_arrays([langs, nothing.cast(pa.string()), nothing.cast(pa.int64()), pa.array(total)], names=["lang", "phrase", "code", "n"])

    sums = texts.mapInArrow(task, COUNTED).groupBy("lang", "phrase").agg(F.first("code").alias("code"), F.sum("n").alias("n"))
    return sums.filter(F.col("phrase").isNull() | (F.col("n") >= least))


def _part(start: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", start, size), " ")


def scored(levels: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the phrases of two words or more in ``levels`` (lang, phrase, a), by their lowest cut."""
    split = levels.withColumn("words", F.split("phrase", " ")).filter(F.size("words") > 1)
    k = F.col("k")
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), k).alias("left"), _part(k + 1, F.size("words") - k).alias("right"))
    cuts = cuts.join(levels.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(levels.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"]).join(totals, "lang")
    big = "cast({} as decimal(19,0))".format
    score = F.expr(f"(cast(1000 * {big('a')} as decimal(22,0)) * {big('n')}) div ({big('l')} * {big('r')})")
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def only_inside(levels: DataFrame) -> DataFrame:
    """(lang, phrase, longer) of the runs of two words or more inside longer phrases of ``levels``, with the highest count of these."""
    split = levels.withColumn("words", F.split("phrase", " ")).filter(F.size("words") > 2)
    m = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), m - 1), lambda size: F.transform(F.sequence(F.lit(1), m - size + 1), lambda at: _part(at, size))))
    return split.select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def mine(docs: DataFrame, least: int = LEAST, best: int = BEST, longest: int = LONGEST, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``best`` phrases of each lang of ``docs`` (lang, text)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found, bitmap = [], None
    for k in range(1, longest + 1):
        own = frequent_codes(texts, k, least, bitmap, bits) if k == 2 else None
        level = materialise(counted(texts, k, least, bitmap, own), f"level-{k}")
        found.append(level)
        grams = level.filter("phrase is not null")
        size = grams.count()
        if not size:
            break
        bitmap = frequent_bits(grams, size, bits) if k < longest else None
    totals = found[0].filter("phrase is null").select("lang", "n")
    levels = reduce(DataFrame.unionByName, found).filter("phrase is not null").select("lang", "phrase", F.col("n").alias("a"))
    marks = scored(levels, totals).join(only_inside(levels), ["lang", "phrase"], "left")
    kept = materialise(marks.filter("longer is null or longer < a").drop("longer"), "scored")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).alias("share")
    first = kept.select("*", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
