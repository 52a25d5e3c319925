"""Pictures in rows: how much of them a worker holds, and that the counts stay whole."""

import tracemalloc

import numpy as np
import pyarrow as pa

from folioflow.plans import inputs
from folioflow.sources import engines


def test_pictures_leave_the_worker_in_bounded_batches():
    texts = ["", *["ab" * 40_000] * 20, "c" * 700_000, "d"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    sent = list(inputs.pictures(iter([batch])))
    assert [n for b in sent for n in b.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert all(b.num_rows == 1 or sum(map(len, b.column("pixels").to_pylist())) <= inputs.PICTURE_BYTES for b in sent)
    assert len(sent[-1].column("pixels")[0].as_py()) == 320 and not sent[0].column("pixels")[0].as_py()


def test_histogram_counts_in_slices(monkeypatch):
    monkeypatch.setattr(engines, "COUNTED_AT_ONCE", 1000)
    image = np.random.default_rng(1).integers(0, 256, (321, 77)).astype(np.uint8)
    assert (engines.histogram(image) == np.bincount(image.reshape(-1), minlength=256)).all()
    assert engines.histogram(np.zeros((0, 320), dtype=np.uint8)).tolist() == [0] * 256


def test_sharpening_by_bands_holds_little(monkeypatch):
    image = np.random.default_rng(2).integers(0, 256, (3000, 1000)).astype(np.uint8)
    monkeypatch.setattr(engines, "COUNTED_AT_ONCE", 1 << 30)
    whole = engines.sharpened(image)
    monkeypatch.undo()
    tracemalloc.start()
    bands = engines.sharpened(image)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (bands == whole).all() and peak < 16 * image.size
