"""Operator 2: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and unlabelled texts (U, of which a share ``prior`` is toxic) train a linear
classifier over the distinct words of a text and their beginnings. With l(z) = log(1 + exp(-z)) the risk is

    prior * mean_P l(f) + max(0, mean_U l(-f) - prior * mean_P l(-f)),

that is, the negatives' risk is estimated from U, corrected by the class prior, and kept from falling
below zero; where it would, its gradient is followed upwards instead. Clean labels serve only to estimate
the prior: the share of toxic labels, less what confirmed rows take out of U.

The classifier is fitted on a bounded sample drawn by a hash of doc_id: about ``POSITIVES`` and
``UNLABELLED`` texts, each distinct text once. Features enter it if they stand in ``MIN_TEXTS`` sampled positive texts
at least and more often in P than in U, by a log-likelihood ratio that no feature would reach by accident; how often
they stand in U is counted over all unlabelled texts, as partial sums. Of a sampled text only the features that
entered reach the driver. Scoring reads every whole text once; the model is a sorted array of feature hashes with
weights. The prior is what the labels say, kept off 0 and 1 by one row.

Defined results: a null text counts as empty and gets the score of the bias; with no positive or no
unlabelled text there is nothing to learn, and all score 0; conflicting labels of one doc_id count as
toxic; a null doc_id is never trained on nor held out; an empty table gives no row. Other columns are
passed on by ``keep_clean`` and ignored by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import chunks, materialise
from folioflow.llm.words import code_points, kinds, mix64, run_sums, runs

POSITIVES = 4000
UNLABELLED = 12000
MIN_TEXTS = 3
#: Chance of one feature or more entering by accident, by which the bound on the log-likelihood ratio is set.
SIGNIFICANCE = 0.001
#: Beginnings of words that count as features beside the words, in code points.
STEMS = (4, 5, 6)
ROUNDS = 1500
DECAY = 1e-5
THRESHOLD = 0.7


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word of the texts, and of the beginnings of longer words."""
    points, owner = code_points([(t or "").lower() for t in texts])
    begin, stop = runs(kinds(points) < 3)
    sums, cuts = run_sums(points, begin, stop)
    length = stop - begin
    rows, hashes = [owner[begin]], [mix64(sums[cuts[1:]] - sums[cuts[:-1]] + mix64(length.astype(np.uint64)))]
    for size in STEMS:
        longer = length > size
        at = cuts[:-1][longer]
        rows.append(owner[begin[longer]])
        hashes.append(mix64(sums[at + size] - sums[at] + mix64(np.array([size + (1 << 40)], dtype=np.uint64))))
    return np.concatenate(rows), np.concatenate(hashes)


def distinct_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The features, each once a text, sorted by text."""
    rows, hashes = features(texts)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[first], hashes[first]


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Score in 0..1 of every text; a feature counts once a text."""
        z = np.full(len(texts), self.bias)
        if len(self.words):
            rows, hashes = features(texts)
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = self.words[at] == hashes
            pairs = np.unique(rows[known] * len(self.words) + at[known])
            z += np.bincount(pairs // len(self.words), weights=self.weights[pairs % len(self.words)], minlength=len(texts))
        return np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _ratio(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Log-likelihood ratio of a of n against b of m, zero where the first share is not the larger."""

    def part(k: np.ndarray, total: int, share: np.ndarray) -> np.ndarray:
        share = np.clip(share, 1e-12, 1 - 1e-12)
        return k * np.log(share) + (total - k) * np.log(1 - share)

    joint = (a + b) / (n + m)
    value = 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, joint) - part(b, m, joint))
    return np.where(a / n > b / m, value, 0.0)


def select_features(words: np.ndarray, found: np.ndarray, n: int, in_unlabelled: np.ndarray, m: int) -> np.ndarray:
    """Which of ``words``, in ``found`` of n positive and in ``in_unlabelled`` of m unlabelled texts, become features."""
    if not n or not m:
        return np.zeros(len(words), dtype=bool)
    bound = 2 * np.log(max(len(words), 1) / SIGNIFICANCE)
    return (found >= MIN_TEXTS) & (_ratio(found, n, in_unlabelled, m) >= bound)


def risk(weights: np.ndarray, bias: float, positive: tuple, unlabelled: tuple, prior: float) -> tuple[float, float, np.ndarray]:
    """Positive part and corrected negative part of the risk, and the gradient to follow (weights, then bias), without decay.

    ``positive`` and ``unlabelled``: number of texts, and (text, feature) pairs as two arrays.
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    softplus = lambda z: np.logaddexp(0, z)
    (n, prow, pcol), (m, urow, ucol) = positive, unlabelled
    fp = np.bincount(prow, weights=weights[pcol], minlength=n) + bias
    fu = np.bincount(urow, weights=weights[ucol], minlength=m) + bias
    negative = softplus(fu).mean() - prior * softplus(fp).mean()
    # Gradients by f: of prior * l(f) over P, and of the corrected risk of the negatives.
    by_p, by_u = -prior * sigmoid(-fp) / n, sigmoid(fu) / m
    if negative >= 0:
        by_p = by_p - prior * sigmoid(fp) / n
    else:
        by_p, by_u = prior * sigmoid(fp) / n, -by_u
    gradient = np.bincount(pcol, weights=by_p[prow], minlength=len(weights)) + np.bincount(ucol, weights=by_u[urow], minlength=len(weights))
    return prior * softplus(-fp).mean(), negative, np.append(gradient, by_p.sum() + by_u.sum())


def train(words: np.ndarray, positive: tuple, unlabelled: tuple, prior: float, rounds: int = ROUNDS, decay: float = DECAY) -> Model:
    """Fit the classifier over the features ``words`` (sorted); ``positive`` and ``unlabelled`` as for ``risk``."""
    if not positive[0] or not unlabelled[0]:
        return NOTHING
    weights, bias = np.zeros(len(words)), float(np.log(prior / (1 - prior)))
    state = np.zeros((2, len(words) + 1))
    for step in range(1, rounds + 1):
        gradient = risk(weights, bias, positive, unlabelled, prior)[2]
        gradient[:-1] += decay * weights
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.999 * state[1] + 0.001 * gradient**2
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Model(words, weights, float(bias))


#: What is learned without a positive or an unlabelled text.
NOTHING = Model(np.zeros(0, dtype=np.uint64), np.zeros(0), -np.inf)


def _known(words: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are among the sorted ``words``, and where."""
    if not len(words):
        return np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return words[at] == hashes, at


def _frequencies(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features that stand in MIN_TEXTS texts at least, sorted, and in how many they stand. For a sample."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found, n = np.unique(distinct_features(batch.column("text").to_pylist())[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["word", "n"])

    table = texts.mapInArrow(task, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_TEXTS).toArrow()
    words, n = np.asarray(table.column("word").combine_chunks()).view(np.uint64), np.asarray(table.column("n").combine_chunks())
    order = np.argsort(words)
    return words[order], n[order]


def _counts_of(texts: DataFrame, words: np.ndarray) -> np.ndarray:
    """In how many texts each of the sorted ``words`` stands: over all of ``texts``, as partial sums."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), dtype=np.int64)
        for batch in chunks(batches, "text"):
            known, at = _known(shared.value, distinct_features(batch.column("text").to_pylist())[1])
            total += np.bincount(at[known], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "n"])

    out = np.zeros(len(words), dtype=np.int64)
    if len(words):
        table = texts.mapInArrow(task, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        out[np.asarray(table.column("place").combine_chunks())] = np.asarray(table.column("n").combine_chunks())
    return out


def _sampled(texts: DataFrame, words: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of texts of a sample, and its (text, feature) pairs over the sorted ``words``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows, hashes = distinct_features(batch.column("text").to_pylist())
            known, at = _known(words, hashes)
            cuts = np.searchsorted(rows[known], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("same"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(at[known].astype(np.int32)))], names=["same", "at"])

    table = texts.mapInArrow(task, "same long, at array<int>").orderBy("same").toArrow()
    lists = table.column("at").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(np.asarray(lists.offsets))
    return table.num_rows, np.repeat(np.arange(table.num_rows), sizes), np.asarray(lists.flatten()).astype(np.int64)


def _drawn(share: float):
    return F.pmod(F.xxhash64("doc_id", F.lit("pu")), F.lit(1 << 24)) < F.lit(int(share * (1 << 24)) + 1)


def _distinct(texts: DataFrame) -> DataFrame:
    """Each text of a sample once: same (its hash) and text."""
    return texts.select(F.xxhash64("text").alias("same"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["same"])


def prior_of(rows: int, labelled: int, positive: int) -> float:
    """The share of toxic texts among the unlabelled: what the labels' share leaves after the confirmed ones are taken out."""
    left = max(rows - labelled, 0) * positive / labelled
    unlabelled = max(rows - positive, 1)
    return min(max(left, 1.0), max(unlabelled - 1.0, 0.5)) / max(unlabelled, 2)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learn from ``labels`` (doc_id, toxic) and the texts of ``docs`` (doc_id, text), both already without held-out rows."""
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = marked.agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p")).first()
    docs = docs.filter(F.col("doc_id").isNotNull())
    rows = docs.count()
    if not count["p"] or not rows:
        return NOTHING
    confirmed = materialise(marked.filter("toxic = 1").select("doc_id"), "confirmed")
    # At most about POSITIVES ids: small enough to go to every executor.
    chosen = F.broadcast(confirmed.filter(_drawn(min(1.0, positives / count["p"]))))
    p = materialise(_distinct(docs.join(chosen, "doc_id", "left_semi")), "positive")
    share = min(1.0, unlabelled / rows)
    u = docs.filter(_drawn(share)).join(F.broadcast(confirmed.filter(_drawn(share))), "doc_id", "left_anti")
    u = materialise(_distinct(u), "unlabelled")
    n = p.count()
    words, found = _frequencies(p)
    # Over all rows that are not confirmed: those of all rows less those of the confirmed ones, which Spark joins by size.
    everything, known = _counts_of(docs, words), docs.join(confirmed, "doc_id", "left_semi")
    counted = everything - _counts_of(known, words)
    words = words[select_features(words, found, n, counted, rows - known.count())]
    return train(words, _sampled(p, words), _sampled(u, words), prior_of(rows, count["n"], count["p"]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (any columns, and text) with ``score`` and ``predicted`` appended."""
    schema = docs.schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = model.scores(batch.column("text").to_pylist())
            columns = [*batch.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    return docs.mapInArrow(task, StructType([*schema.fields]).add("score", DoubleType()).add("predicted", IntegerType()))


def remainder(modulus: int):
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def fit_outside_fold(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, **options) -> Model:
    """Learn from the rows whose fold is not the held one."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    used = remainder(folds) != held_fold
    return fit(plain.filter(used), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(used), **options)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""
    model = fit_outside_fold(docs, labels, folds, held_fold, **options)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(remainder(folds) == held_fold, F.lit(False)).alias("held_out")
    return score(plain.select("doc_id", held, "text"), model).drop("text")


def keep_clean(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with the columns of ``docs``."""
    model = fit_outside_fold(docs, labels, folds, held_fold, **options)
    names = [f"__c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = plain[names[docs.columns.index("text")]].cast("string")
    scored = score(plain.withColumn("text", text), model)
    return scored.filter("predicted = 0").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
