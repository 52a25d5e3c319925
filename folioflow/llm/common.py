"""What the training-data operators share: shared scratch space and Arrow batch handling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.session import materialise, scratch, shared_dir  # noqa: F401  (operators take them from here)

#: Code points handled at once in a Python worker; a longer text is handled alone.
CHUNK_CHARS = 1_500_000
#: A key is heavy if it has more than one in HEAVY_KEYS rows, and more than HEAVY_ROWS.
HEAVY_KEYS, HEAVY_ROWS = 1000, 1000


def partitions_for(size: int | None, spark: SparkSession, each: int = 64 << 20) -> int:
    """Partitions for ``size`` bytes of about ``each`` bytes, as many as Spark's own setting at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size or 0) // each), 1)


def heavy_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "left") -> DataFrame:
    """``left`` join ``right`` by ``key``, no key of which lands in one task with more than a thousandth of the rows.

    ``right`` has a row per key, with ``weight``, about how many rows of ``left`` have it. Keys heavier than a
    thousandth of the total, of which there are a thousand at most, are broadcast; the rest are shuffled.
    Both sides should be cheap to read twice. ``weight`` is dropped. A null key meets nothing.
    """
    bound = right.agg(F.max(weight).alias("most"), F.sum(weight).alias("total")).first()
    limit = max((bound["total"] or 0) // HEAVY_KEYS, HEAVY_ROWS)
    plain = right.drop(weight)
    if (bound["most"] or 0) <= limit:
        return left.join(plain, key, how)
    heavy = F.broadcast(right.filter(F.col(weight) > limit).drop(weight))
    apart = left.join(F.broadcast(right.filter(F.col(weight) > limit).select(key)), key, "left_anti")
    return left.join(heavy, key).unionByName(apart.join(right.filter(F.col(weight) <= limit).drop(weight), key, how))


def salted_join(left: DataFrame, right: DataFrame, key: str, shares: DataFrame, weight: str, salt, spread: int = 64) -> DataFrame:
    """``left`` join ``right`` by ``key``, of which ``right`` may have several rows; heavy keys are dealt over ``spread`` tasks by ``salt``.

    ``shares`` has a row per key with ``weight``, the rows of ``left`` that have it. Only the names of heavy
    keys, a thousand at most, are broadcast.
    """
    shares = materialise(shares, "shares")
    bound = shares.agg(F.max(weight).alias("most"), F.sum(weight).alias("total")).first()
    limit = max((bound["total"] or 0) // HEAVY_KEYS, HEAVY_ROWS)
    if (bound["most"] or 0) <= limit:
        return left.join(right, key)
    heavy = F.broadcast(shares.filter(F.col(weight) > limit).select(key, F.lit(spread).alias("salts")))
    salts = F.coalesce("salts", F.lit(1)).cast("long")
    dealt = left.join(heavy, key, "left").withColumn("salt", F.pmod(F.xxhash64(salt), salts)).drop("salts")
    copied = right.join(heavy, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    return dealt.join(copied, [key, "salt"]).drop("salt")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch path through Spark's file system layer."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Re-cut Arrow batches so that ``column`` (string) holds about ``limit`` bytes in each, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            done, start = int(ends[stop - 1]), stop


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start..start+count-1 of every row, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total, dtype=np.int64)


def binary_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row i is the bytes of data[bounds[i]:bounds[i+1]]; no copy per row."""
    offsets = (np.asarray(bounds, dtype=np.int64) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
