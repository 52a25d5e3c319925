"""Operator 5: language identification by the nearest of several centroids per language.

A text becomes a vector of character trigrams inside words (lower-case letters, word edges marked),
hashed to ``DIMENSIONS`` places, weighted log(1 + count) * idf, and scaled to length one. Each language's
training vectors are clustered on the sphere into ``CENTROIDS`` centroids. A text gets the language of the
centroid with the largest cosine; a text farther from it than nearly all training texts of that centroid
were is rejected (column ``rejected``).

Document frequencies cover every training row. The centroids are fitted on a bounded sample: texts are
drawn by a hash of doc_id, about ``SAMPLE_ROWS`` over all languages, shared evenly between them. The model
is one small matrix (languages x CENTROIDS x DIMENSIONS, 64 KB a language).

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; if nothing
can be learned, everything is ``und``; equal texts get equal results; a null doc_id is never held out
nor trained on; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import chunks
from folioflow.llm.words import LETTER, code_points, kinds, mix64

DIMENSIONS = 4096
CENTROIDS = 4
SAMPLE_ROWS = 6000
ROUNDS = 12
#: A text is rejected when its cosine is below this quantile of its centroid's training cosines, times REACH.
QUANTILE, REACH = 0.01, 0.8
UNKNOWN = "und"
#: Texts turned into vectors at once.
ROWS = 1024


def counts(texts: list[str | None]) -> np.ndarray:
    """Trigram counts, float32 of (texts, DIMENSIONS)."""
    points, owner = code_points([(t or "").lower() for t in texts])
    letter = kinds(points) == LETTER
    plain = np.where(letter, points, 0x20).astype(np.uint64)
    middle = np.flatnonzero(letter)
    middle = middle[middle > 0]
    first = np.flatnonzero(letter[:1])  # a letter at the very start has a word edge before it
    before = np.concatenate([np.full(len(first), 0x20, dtype=np.uint64), plain[middle - 1]])
    middle = np.concatenate([first, middle])
    grams = mix64((before << np.uint64(42)) | (plain[middle] << np.uint64(21)) | plain[middle + 1]) % np.uint64(DIMENSIONS)
    places = owner[middle] * DIMENSIONS + grams.astype(np.int64)
    return np.bincount(places, minlength=len(texts) * DIMENSIONS).reshape(len(texts), DIMENSIONS).astype(np.float32)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted rows of length one; rows without a trigram stay zero."""
    weighted = np.log1p(found) * idf
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)


def spherical_clusters(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means on the sphere, started from the rows farthest from one another."""
    centroids = rows.mean(axis=0, keepdims=True)
    centroids /= max(np.linalg.norm(centroids), 1e-12)
    while len(centroids) < min(k, len(rows)):
        centroids = np.vstack([centroids, rows[np.argmin((rows @ centroids.T).max(axis=1))]])
    for _ in range(rounds):
        near = np.argmax(rows @ centroids.T, axis=1)
        sums = np.stack([rows[near == c].sum(axis=0) if (near == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray  # language number of each centroid
    nearest: np.ndarray  # cosine below which a text is rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score in 0..1, and whether the text is too far from all centroids."""
        found = counts(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        cosines = vectors(found, self.idf) @ self.centroids.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        some = found.any(axis=1)
        languages = [self.languages[self.owner[b]] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
        return languages, np.where(some, score, 0.0), ~some | (score < self.nearest[best])


def remainder(modulus: int):
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def fit(training: DataFrame, sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS) -> Model:
    """Learn from ``training`` (doc_id, text, lang), lang not null."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS, dtype=np.int64)
        for batch in _cut(batches):
            total += (counts(batch.column("text").to_pylist()) > 0).sum(axis=0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["place", "n"])

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            found = counts(batch.column("text").to_pylist()).astype("<u4")
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([row.tobytes() for row in found], pa.binary())], names=["lang", "counts"])

    sizes = {r["lang"]: r["count"] for r in training.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros(DIMENSIONS), np.zeros((0, DIMENSIONS)), np.zeros(0, dtype=int), np.zeros(0))
    df = np.zeros(DIMENSIONS)
    for r in training.select("text").mapInArrow(frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        df[r["place"]] = r["n"]
    idf = np.log((1 + sum(sizes.values())) / (1 + df)).astype(np.float32) + 1
    each = max(1, sample_rows // len(sizes))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, each / n))])
    drawn = training.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    rows: dict[str, list] = {lang: [] for lang in sorted(sizes)}
    for r in drawn.select("lang", "text").mapInArrow(sampled, "lang string, counts binary").toLocalIterator():
        if len(rows[r["lang"]]) < 2 * each:
            rows[r["lang"]].append(np.frombuffer(r["counts"], "<u4"))
    languages = [lang for lang, found in rows.items() if found]
    fitted, owner, nearest = [], [], []
    for number, lang in enumerate(languages):
        own = vectors(np.stack(rows[lang]).astype(np.float32), idf)
        own = own[own.any(axis=1)]
        if not len(own):
            continue
        found = spherical_clusters(own, centroids)
        cosines = own @ found.T
        best = cosines.argmax(axis=1)
        for c in range(len(found)):
            near = cosines[best == c, c]
            nearest.append(REACH * float(np.quantile(near, QUANTILE)) if len(near) else 0.0)
        fitted.append(found)
        owner += [number] * len(found)
    if not fitted:
        return Model([], idf, np.zeros((0, DIMENSIONS)), np.zeros(0, dtype=int), np.zeros(0))
    return Model(languages, idf, np.vstack(fitted).astype(np.float32), np.array(owner), np.array(nearest))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row of ``docs`` (doc_id, text, held_out)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            languages, score, rejected = model.predict(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(languages, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.mapInArrow(task, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame, folds: int = 5, held_fold: int = 0, **options) -> DataFrame:
    """Learn from the rows of ``docs`` (doc_id, text, lang) outside the held fold, and identify every row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    training = plain.filter(F.col("lang").isNotNull() & (remainder(folds) != held_fold))
    held = F.coalesce(remainder(folds) == held_fold, F.lit(False)).alias("held_out")
    return identify(plain.select("doc_id", "text", held), fit(training, **options))
