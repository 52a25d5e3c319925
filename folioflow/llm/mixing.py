"""Operator 6: mixing sources to target weights by pivotal dependent rounding.

Targets are a water-filling: every source asks for a share of the mix by its weight, no source gets more
than ``ceiling`` times its own words, and what it cannot take is shared again by weight. The level at
which the shares fit is found by a few aggregations over the table of sources; only two numbers a round
reach the driver.

Every document of a source starts with the same copy probability target / size of the source: some whole
copies and a fraction. Fractions are rounded by the pivotal method: two documents trade words at random,
each keeping its expectation, until one of them is a whole number of copies; the other goes on to the
next. So the words taken from the source never change, and each document's expectation holds. Sources
are split into leaves of ``leaf_rows`` documents by a hash of doc_id, text and, where rows repeat, their number; each leaf is rounded in one task and
leaves one document unsettled. The unsettled ones of up to ``leaf_rows`` leaves meet on the next level, and
so on up a tree. The last document of a source takes the words that are left as a partial copy (the
first words of its text), so a source meets its target to within one word.

All random numbers are hashes of the source and of the document's place in the tree, so a rerun gives the
same mix, and sources are rounded independently.

Defined results: a null text has size 0; documents of size 0, and all of a source without words, take 0;
a null source is a source of its own and comes last; rows that repeat are rounded one by one; a null
doc_id is kept; an empty table gives no row. Other columns are ignored by ``mix`` and kept by ``apply_mix``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import materialise

WEIGHTS = (3, 1, 2)
#: Documents rounded together in one task.
LEAF_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` (one row per source) with ``rank``, from 0, by code point, null last; ranks are dealt by range partition."""
    placed = materialise(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())
    before, bases = 0, []
    for part, n in counts:
        bases.append((part, before))
        before += n
    base = placed.sparkSession.createDataFrame(bases or [(0, 0)], "part int, before long")
    order = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return placed.withColumn("n", F.row_number().over(order)).join(F.broadcast(base), "part").select("source", "rows", "source_size", (F.col("before") + F.col("n") - 1).alias("rank"))


def water_level(sources: DataFrame, total: float, ceiling: float) -> float:
    """The words per unit of weight at which shares min(ceiling * size, level * weight) add up to ``total``."""
    level = 0.0
    while True:
        full = F.col("source_size") * ceiling <= level * F.col("weight")
        row = sources.agg(
            F.sum(F.when(full, F.col("source_size") * ceiling).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")
        ).first()
        if not row["open"]:
            return level
        raised = (total - row["held"]) / row["open"]
        if raised <= level * (1 + 1e-12):
            return level
        level = raised


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """source, rows, source_size and target of every source of ``sized`` (source, size)."""
    sources = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    sources = ranked(sources).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    sources = materialise(sources, "targets")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, share * total, ceiling)
    return sources.select("source", "rows", "source_size", F.least(F.col("source_size") * ceiling, F.lit(level) * F.col("weight")).cast("double").alias("target"))


def _uniform(*parts: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on integers alone."""
    x = np.full(len(parts[0]), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for p in parts:
        x ^= p.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) + (x << np.uint64(6)) + (x >> np.uint64(2))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def pivotal(sizes: list[int], fractions: list[float], draws: list[float]) -> tuple[list[float], int]:
    """Round fractions to 0 or 1 by trading words in pairs; what is returned as second is the place left unsettled, or -1.

    In a trade, i and j move d words between them: up to where one of the two becomes 0 or 1. Of the two
    directions each is drawn with the chance that leaves both expectations as they were.
    """
    out = list(fractions)
    held = -1
    for j, x in enumerate(out):
        if x <= 1e-12 or x >= 1 - 1e-12:
            out[j] = float(round(x))
            continue
        if held < 0:
            held = j
            continue
        a, b = sizes[held], sizes[j]
        wa, wb = out[held] * a, x * b
        up = min(a - wa, wb)  # words from j to the held one
        down = min(wa, b - wb)
        if draws[j] < down / (up + down):
            wa, wb = wa + up, wb - up
        else:
            wa, wb = wa - down, wb + down
        out[held], out[j] = wa / a, wb / b
        settled = [abs(v - round(v)) <= 1e-12 for v in (out[held], out[j])]
        for k, s in ((held, settled[0]), (j, settled[1])):
            if s:
                out[k] = float(round(out[k]))
        held = -1 if all(settled) else j if settled[0] else held
    return out, held


_LEAF = "source string, leaf long, place long, doc_id long, same long, size long, x double, level int, open boolean"


def _round(group: pd.DataFrame, level: int) -> pd.DataFrame:
    """Round one leaf, or one knot of the tree; at most one row stays open."""
    group = group.sort_values(["leaf", "place"], kind="stable") if level else group.sort_values(["size", "doc_id", "same"], kind="stable", na_position="first")
    if not level:
        group["place"] = np.arange(len(group))
    source = group["source"].iloc[0]
    seed = zlib.crc32(b"\0" if source is None or source != source else source.encode())
    draws = _uniform(np.full(len(group), seed), group["leaf"].to_numpy(), group["place"].to_numpy(), np.full(len(group), level))
    x, held = pivotal(group["size"].tolist(), group["x"].tolist(), draws.tolist())
    group["x"], group["level"], group["open"] = x, level, False
    if held >= 0:
        group.iloc[held, group.columns.get_loc("open")] = True
    return group[[f.split()[0] for f in _LEAF.split(", ")]]


def _rounded(rows: DataFrame, level: int, fanout: int) -> DataFrame:
    knot = F.floor(F.col("leaf") / F.lit(fanout**level)).alias("knot") if level else F.col("leaf").alias("knot")

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        return _round(group, level)

    return rows.groupBy("source", knot).applyInPandas(settle, _LEAF)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, ceiling: float = 2.0, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """doc_id, source, same (a hash of the text), size, source_size, target and taken (words, repeats counted) of every row of ``docs`` (doc_id, text, source)."""
    text = F.col("text").cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("same"), word_count(text).alias("size"))
    repeated = plain.groupBy(*plain.columns).count()
    sized = materialise(repeated.select(*plain.columns, F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("number")), "sizes")
    goals = materialise(targets(sized, weights, share, ceiling), "goals")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    same = sized["source"].eqNullSafe(goals["source"])
    joined = sized.join(goals, same).select(
        sized["source"],
        F.pmod(F.xxhash64("doc_id", "same", "number"), F.greatest(F.ceil(F.col("rows") / leaf_rows), F.lit(1))).alias("leaf"),
        "doc_id",
        "same",
        "size",
        "source_size",
        "target",
        F.floor(rate).alias("whole"),
    )
    fraction = (F.col("target") / F.col("source_size")) - F.floor(F.col("target") / F.col("source_size"))
    small = F.col("size") <= 0
    start = joined.select("source", "leaf", F.lit(0).cast("long").alias("place"), "doc_id", "same", "size", F.when(small | (F.col("source_size") <= 0), 0.0).otherwise(fraction).alias("x"))
    leaves = materialise(_rounded(start, 0, leaf_rows), "leaves")
    level, fanout, finished = 0, leaf_rows, []
    most = goals.agg(F.max(F.ceil(F.col("rows") / leaf_rows))).first()[0] or 0
    current = leaves
    while fanout**level < most:
        level += 1
        current = materialise(_rounded(current.filter("open").select("source", "leaf", "place", "doc_id", "same", "size", "x"), level, fanout), f"level{level}")
        finished.append(current)
    return _taken(leaves, finished, goals)


def _taken(leaves: DataFrame, levels: list[DataFrame], goals: DataFrame) -> DataFrame:
    """Settled rows of all levels with their words. A row that went up the tree counts as its highest level left it."""
    rows = leaves.filter(~F.col("open")) if levels else leaves
    for k, upper in enumerate(levels):
        rows = rows.unionByName(upper.filter(~F.col("open")) if k + 1 < len(levels) else upper)
    rows = rows.join(goals, rows["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    words = F.floor(rate) * F.col("size") + F.round(F.col("x") * F.col("size"))
    return rows.select("doc_id", "source", "same", "size", "source_size", "target", words.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row per whole copy, and the first words of a text that is taken in part.

    Rows equal in doc_id, source and text are told apart by their order. Columns may have any names.
    """
    taken = mix(docs, **options)
    names = [f"c{k}" for k in range(len(docs.columns))]
    place = dict(zip(docs.columns, names, strict=True))
    plain = docs.toDF(*names)
    text = F.col(place["text"]).cast("string")
    keys = [F.col(place["doc_id"]).cast("long").alias("doc_id"), F.col(place["source"]).cast("string").alias("source"), F.xxhash64(text).alias("same")]
    alike = Window.partitionBy("doc_id", "source", "same")
    left = plain.select("*", *keys, word_count(text).alias("size")).withColumn("n", F.row_number().over(alike.orderBy("size")))
    right = taken.select("doc_id", "source", "same", "taken", F.row_number().over(alike.orderBy("taken")).alias("n"))
    equal = [left[k].eqNullSafe(right[k]) for k in ("doc_id", "source", "same", "n")]
    joined = left.join(right, equal).filter("taken > 0").select(*names, "size", "taken")
    words = F.col("taken") % F.col("size")
    sizes = F.concat(F.array_repeat(F.col("size"), (F.col("taken") / F.col("size")).cast("int")), F.when(words > 0, F.array(words)).otherwise(F.array().cast("array<bigint>")))
    rows = joined.withColumn("words", F.explode(sizes))
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    made = F.when(F.col("words") == F.col("size"), text).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), ""))
    new = {place["text"]: made}
    if "n_chars" in place:
        new[place["n_chars"]] = F.length(made).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(n, F.col(n)).alias(c) for c, n in place.items()])
