"""Grey pictures in a binary column: what recognition wants to know of them, and the greys of all of them together."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources import engines

MEASURES = "doc_id long, dark long, total long, blank boolean, candidate boolean, low int, high int, sharp_crc32 long, binary_crc32 long"


def _images(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The pictures of rows (width, pixels), row by row of pixels."""
    for width, pixels in zip(batch.column("width").to_pylist(), batch.column("pixels"), strict=True):
        yield np.frombuffer(pixels.as_buffer() or b"", dtype=np.uint8).reshape(-1, width)


def measures(rasters: DataFrame) -> DataFrame:
    """MEASURES of ``rasters`` (doc_id, width, pixels): dark pixels and all, blank or a candidate for recognition, the bounds of the contrast, and checksums of what recognition is shown.

    A picture without pixels is blank and no candidate; its bounds are 0.
    """
    from folioflow import settings as S

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MEASURES.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, image in zip(batch.column("doc_id").to_pylist(), _images(batch), strict=True):
                greys = engines.histogram(image)
                shown = [zlib.crc32(engines.image_variant(image, v).tobytes()) for v in ("contrast_sharp", "binary")]
                rows.append((doc_id, int(greys[: S.DARK_BELOW].sum()), image.size, engines.is_blank(image), engines.is_candidate(image), *engines.contrast_bounds(greys), *shown))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names).cast(pa.schema([("doc_id", pa.int64()), ("dark", pa.int64()), ("total", pa.int64()), ("blank", pa.bool_()), ("candidate", pa.bool_()), ("low", pa.int32()), ("high", pa.int32()), ("sharp_crc32", pa.int64()), ("binary_crc32", pa.int64())]))

    return rasters.select("doc_id", "width", "pixels").mapInArrow(task, MEASURES)


def greys(rasters: DataFrame) -> DataFrame:
    """grey and pixels, over all ``rasters`` (width, pixels): sums per task, then of at most 256 rows a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for batch in batches:
            for image in _images(batch):
                total += engines.histogram(image)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["grey", "pixels"])

    return rasters.select("width", "pixels").mapInArrow(task, "grey long, pixels long").groupBy("grey").agg(F.sum("pixels").alias("pixels"))
