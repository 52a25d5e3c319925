"""Engines that decode pages and recognise images, run by Python workers.

``FakePdf`` and ``FakeOcr`` stand in for them in tests. The real ones are imported when first used; an
engine whose library is missing raises ``EngineMissing`` when it is asked for a page.
"""

from __future__ import annotations

import os
import shutil
import socket
import subprocess
from collections.abc import Callable, Iterator
from contextlib import closing
from dataclasses import dataclass, field
from importlib.util import find_spec
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from folioflow import settings as S

TEXT_TIMEOUT, TABLE_TIMEOUT, PROBE_TIMEOUT = 240, 300, 15
COUNTED_AT_ONCE = 1 << 20


class EngineMissing(RuntimeError):
    """The library or program of an engine is not installed."""


class PdfEngine(Protocol):
    def page_texts(self, content: bytes) -> list[str]: ...

    def render(self, content: bytes, page: int, dpi: int) -> np.ndarray: ...


@dataclass
class OpenedEachTime:
    """A document whose engine opens it for every page."""

    engine: PdfEngine
    content: bytes

    def render(self, page: int, dpi: int) -> np.ndarray:
        return self.engine.render(self.content, page, dpi)

    def close(self) -> None:
        pass


def opened(engine: PdfEngine, content: bytes):
    """A document, with ``render(page, dpi)`` and ``close()``: opened once by engines that can."""
    return engine.opened(content) if hasattr(engine, "opened") else OpenedEachTime(engine, content)


class OcrEngine(Protocol):
    def table(self, image: np.ndarray, psm: int) -> str: ...

    def text(self, image: np.ndarray, psm: int) -> str: ...


class PictureEngine(Protocol):
    def grey(self, content: bytes) -> np.ndarray: ...


@dataclass
class FakePdf:
    """Pages are what stands between form feeds of the file; every page's picture is the same."""

    picture: np.ndarray = field(default_factory=lambda: np.zeros((10, 10), dtype=np.uint8))

    def page_texts(self, content: bytes) -> list[str]:
        return content.decode().split("\f") if content else []

    def render(self, content: bytes, page: int, dpi: int) -> np.ndarray:
        return self.picture


@dataclass
class FakeOcr:
    """Gives a fixed word table, and a fixed text in text mode."""

    answer: str = ""
    plain: str = ""

    def table(self, image: np.ndarray, psm: int) -> str:
        return self.answer

    def text(self, image: np.ndarray, psm: int) -> str:
        return self.plain


@dataclass
class FakePictures:
    """Every picture is the same; a file of b"broken" is none."""

    picture: np.ndarray = field(default_factory=lambda: np.zeros((400, 400), dtype=np.uint8))

    def grey(self, content: bytes) -> np.ndarray:
        if content == b"broken":
            raise ValueError("no picture")
        return self.picture


class Pillow:
    """Embedded pictures in grey, by Pillow."""

    def grey(self, content: bytes) -> np.ndarray:
        if not find_spec("PIL"):
            raise EngineMissing("PIL")
        import io

        from PIL import Image

        Image.MAX_IMAGE_PIXELS = S.MAX_IMAGE_PIXELS
        return np.asarray(Image.open(io.BytesIO(content)).convert("L"))


@dataclass
class PdfiumDocument:
    document: object

    def render(self, page: int, dpi: int) -> np.ndarray:
        shown = self.document[page - 1]
        try:
            return np.array(shown.render(scale=max(1, dpi / 72), grayscale=True).to_numpy())
        finally:
            shown.close()

    def close(self) -> None:
        self.document.close()


class Pdfium:
    """Text layers and pictures of PDF pages by PDFium."""

    def opened(self, content: bytes) -> PdfiumDocument:
        return PdfiumDocument(self._open(content))

    def _open(self, content: bytes):
        if not find_spec("pypdfium2"):
            raise EngineMissing("pypdfium2")
        import pypdfium2

        return pypdfium2.PdfDocument(content)

    def page_texts(self, content: bytes) -> list[str]:
        document = self._open(content)
        texts = []
        try:
            for page in document:
                layer = page.get_textpage()
                texts.append(layer.get_text_range().replace("\r\n", "\n").replace("\r", "\n").strip())
                layer.close()
                page.close()
        finally:
            document.close()
        return texts

    def render(self, content: bytes, page: int, dpi: int) -> np.ndarray:
        with closing(self.opened(content)) as document:
            return document.render(page, dpi)


@dataclass
class Tesseract:
    """Word tables by the Tesseract program."""

    path: str
    languages: str
    data: str | None = None

    def table(self, image: np.ndarray, psm: int) -> str:
        """A word table; an error with the program's own words if it fails."""
        return self._ask(image, psm, TABLE_TIMEOUT, "-c", "tessedit_create_tsv=1")

    def text(self, image: np.ndarray, psm: int) -> str:
        """Plain text; an error with the program's own words if it fails."""
        return self._ask(image, psm, TEXT_TIMEOUT)

    def _ask(self, image: np.ndarray, psm: int, timeout: int, *options: str) -> str:
        header = f"P5 {image.shape[1]} {image.shape[0]} 255\n".encode()
        where = ["--tessdata-dir", self.data] if self.data else []
        command = [self.path, "stdin", "stdout", *where, "-l", self.languages, "--psm", str(psm), *options]
        done = subprocess.run(command, input=header + np.ascontiguousarray(image, dtype=np.uint8).tobytes(), capture_output=True, timeout=timeout)
        if done.returncode:
            raise RuntimeError(done.stderr.decode("utf-8", "replace").strip() or f"exit code {done.returncode}")
        return done.stdout.decode("utf-8", "replace")


@dataclass(frozen=True)
class EngineInfo:
    """What is known of the recognition program on this machine."""

    path: str | None = None
    languages: tuple[str, ...] = ()
    data: str | None = None
    version: str | None = None


# Names and places of the recognition program and of its language data.
PROGRAM, BUNDLED = "tesseract", "tesseract.exe"
USUAL_PLACES = ("C:/Program Files/Tesseract-OCR/tesseract.exe", "C:/Program Files (x86)/Tesseract-OCR/tesseract.exe")
DATA_PLACES = ("tessdata", "runtime/tessdata")


def find_program(settings: S.Settings, bundle: str, usual: tuple[str, ...] = USUAL_PLACES) -> str | None:
    """The recognition program: as set if it is there, the bundled one, that on the search path, or one in the usual places."""
    own = os.path.join(bundle, BUNDLED)
    known = [settings.tesseract_path, own if os.path.exists(own) else shutil.which(PROGRAM), *usual]
    return next((p for p in known if p and os.path.exists(p)), None)


def find_data(settings: S.Settings, bundle: str) -> str | None:
    """The folder of language data: as set, or the first that is there, in the bundle, the folders above it, or the working folder."""
    if settings.tessdata_dir:
        return settings.tessdata_dir if os.path.exists(settings.tessdata_dir) else None
    above = [bundle, os.path.dirname(bundle), os.path.dirname(os.path.dirname(bundle))]
    places = [os.path.join(folder, DATA_PLACES[0]) for folder in above] + [os.path.join(above[-1], DATA_PLACES[1]), *(os.path.join(os.getcwd(), place) for place in DATA_PLACES)]
    return next((p for p in places if os.path.exists(p)), None)


def probe(settings: S.Settings, bundle: str | None = None, usual: tuple[str, ...] = USUAL_PLACES) -> EngineInfo:
    """Find the recognition program of this machine and ask for its version and languages; does not change the environment. ``bundle``: the program's own folder."""
    bundle = bundle or os.path.dirname(os.path.abspath(__file__))
    path, data = find_program(settings, bundle, usual), find_data(settings, bundle)
    if not path:
        return EngineInfo(data=data)

    def ask(*options: str) -> list[str]:
        try:
            return subprocess.run([path, *options], capture_output=True, text=True, encoding="utf-8", errors="ignore", timeout=PROBE_TIMEOUT).stdout.splitlines()
        except (OSError, subprocess.TimeoutExpired):
            return []

    version = ask("--version")
    listed = ask(*(["--tessdata-dir", data] if data else []), "--list-langs")
    languages = tuple(x.strip() for x in listed if x.strip() and not x.strip().lower().startswith("list of"))
    return EngineInfo(path, languages, data, version[0].strip().removeprefix(f"{PROGRAM} ") or None if version else None)


PROBED = "host string, path string, languages array<string>, data string, version string"


def probe_executors(spark: SparkSession, settings: S.Settings, tasks: int | None = None, **places) -> DataFrame:
    """What ``probe`` finds where tasks run (PROBED), a row for each host and finding: executors may differ from the driver and from one another."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                info = probe(settings, **places)
                yield pd.DataFrame([(socket.gethostname(), info.path, list(info.languages), info.data, info.version)], columns=[c.split()[0] for c in PROBED.split(", ")])

    tasks = tasks or spark.sparkContext.defaultParallelism
    return spark.range(tasks, numPartitions=tasks).mapInPandas(work, PROBED).distinct()


def common_info(found: DataFrame) -> EngineInfo:
    """What all executors have: a program only if each has one at the same place, and the languages that each has."""
    rows = found.collect()
    paths = {r["path"] for r in rows}
    if len(paths) != 1 or None in paths:
        return EngineInfo()
    languages = tuple(x for x in rows[0]["languages"] if all(x in r["languages"] for r in rows))
    return EngineInfo(rows[0]["path"], languages, rows[0]["data"], rows[0]["version"])


def third_party_markdown(content: bytes, name: str, engine: str) -> str:
    """Markdown of a file by an optional converter library: ``markitdown`` or ``docling``."""
    if not find_spec(engine):
        raise EngineMissing(engine)
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=name) as file:
        file.write(content)
        file.flush()
        if engine == "markitdown":
            from markitdown import MarkItDown

            return result_text(MarkItDown(enable_plugins=False).convert(file.name))
        from docling.document_converter import DocumentConverter

        return DocumentConverter().convert(file.name).document.export_to_markdown()


def result_text(result: object) -> str:
    """The first text among the fields that converters use for their output."""
    texts = (getattr(result, name, None) for name in ("text_content", "markdown", "text"))
    return next((t for t in texts if isinstance(t, str)), str(result))


def histogram(image: np.ndarray) -> np.ndarray:
    """Pixels of each grey, counted by a million at a time, because counting widens each to 64 bits."""
    flat = image.reshape(-1)
    return sum((np.bincount(flat[k : k + COUNTED_AT_ONCE], minlength=256) for k in range(0, flat.size, COUNTED_AT_ONCE)), np.zeros(256, dtype=np.int64))


def dark_share(image: np.ndarray) -> float:
    """Share of pixels that are darker than paper."""
    return float(histogram(image)[: S.DARK_BELOW].sum() / image.size) if image.size else 0.0


def is_blank(image: np.ndarray) -> bool:
    return dark_share(image) < S.BLANK_DARK_SHARE


def is_candidate(image: np.ndarray) -> bool:
    """Is an embedded picture large enough, and dark enough, to hold text?"""
    height, width = image.shape[:2]
    return width >= S.IMAGE_MIN_WIDTH and height >= S.IMAGE_MIN_HEIGHT and width * height >= S.IMAGE_MIN_PIXELS and not is_blank(image)


def contrast_bounds(histogram: np.ndarray, cut: int = S.CONTRAST_CUT) -> tuple[int, int]:
    """The darkest and the lightest grey that stay when ``cut`` per cent of the pixels go at either end. Whole pixels are cut, and a grey may be cut in part."""
    share = int(histogram.sum()) * cut // 100
    darker, lighter = np.cumsum(histogram) > share, np.cumsum(histogram[::-1])[::-1] > share
    return (int(darker.argmax()), int(np.flatnonzero(lighter)[-1])) if darker.any() else (0, 0)


def contrast_table(histogram: np.ndarray) -> np.ndarray:
    """What each grey becomes when the greys between the bounds are stretched to 0..255; all stay if the bounds are one."""
    low, high = contrast_bounds(histogram)
    greys = np.arange(256)
    if high <= low:
        return greys.astype(np.uint8)
    scale = 255.0 / (high - low)
    return np.clip(np.trunc(greys * scale - low * scale), 0, 255).astype(np.uint8)


def sharpened(image: np.ndarray) -> np.ndarray:
    """Each pixel twice less the mean of the eight around it: weights -2 around 32, over 16. Pixels of the border stay."""
    if min(image.shape) < 3:
        return image
    rows, columns = image.shape
    out = image.copy()
    step = max(1, COUNTED_AT_ONCE // columns)
    for top in range(1, rows - 1, step):  # by bands of about a million pixels: sums and means are wider than pixels
        high = min(step, rows - 1 - top)
        whole = image[top - 1 : top + high + 1].astype(np.int32)
        near = sum(whole[y : high + y, x : columns - 2 + x] for y in range(3) for x in range(3))
        value = (34 * whole[1:-1, 1:-1] - 2 * near) / 16
        out[top : top + high, 1:-1] = np.clip(np.floor(value + 0.5), 0, 255).astype(np.uint8)
    return out


def image_variant(image: np.ndarray, variant: str) -> np.ndarray:
    """A grey picture as it is, with contrast stretched and sharpened, or in black and white."""
    if variant == "gray":
        return image
    stretched = contrast_table(histogram(image))[image]
    return np.where(stretched > S.WHITE_ABOVE, 255, 0).astype(np.uint8) if variant == "binary" else sharpened(stretched)


def pdf_pages(files: DataFrame, engine: Callable[[], PdfEngine]) -> DataFrame:
    """doc_id, page_index and page_text of ``files`` (doc_id, content); a file that cannot be read gives no row."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener = engine()
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    texts = opener.page_texts(content)
                except Exception:
                    texts = []
                if texts:
                    yield pd.DataFrame({"doc_id": [doc_id] * len(texts), "page_index": range(1, len(texts) + 1), "page_text": texts})

    return files.select("doc_id", "content").mapInPandas(read, "doc_id long, page_index int, page_text string")


def other_converters(files: DataFrame, convert: Callable[[bytes, str, str], str]) -> DataFrame:
    """doc_id, other_text, other_method and other_error of ``files`` (doc_id, ext, doc_type, content): the first converter that gives text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, ext, kind, content in zip(batch["doc_id"], batch["ext"], batch["doc_type"], batch["content"], strict=True):
                docling = ("Docling OCR" if kind in (S.SCAN, S.MIXED) else "Docling", "docling")
                chain = [("MarkItDown", "markitdown"), docling] if kind == S.DOCX else [docling, ("MarkItDown", "markitdown")]
                text, method, errors = "", "", []
                for method, engine in chain:
                    try:
                        text = convert(content, ext, engine) or ""
                        if text.strip():
                            break
                        errors.append(f"{method}: пустой результат")
                    except Exception as problem:
                        errors.append(f"{method}: {problem}")
                    text = ""
                yield pd.DataFrame({"doc_id": [doc_id], "other_text": [text], "other_method": [method], "other_error": ["; ".join(errors)]})

    return files.select("doc_id", "ext", "doc_type", "content").mapInPandas(work, "doc_id long, other_text string, other_method string, other_error string")
