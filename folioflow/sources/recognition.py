"""Recognition of pages and pictures: a search over the attempts at a picture that stops as soon as the best is good enough.

Attempts are costly, and whether the next is needed depends on those before it, so the search runs inside the task, one
picture after the other; a resolution is rendered only when the search comes to it. A row per picture leaves the
worker. Where all attempts exist as rows already, ``operators.ocr.best_attempts`` makes the same choice by a window.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import closing
from decimal import ROUND_HALF_EVEN, Decimal
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow import settings as S
from folioflow.sources import engines

COLUMNS = ("block_num", "par_num", "line_num", "conf", "text")
CHOSEN = "text string, confidence double, dpi int, variant string, psm int, score double, attempt_count int, attempt_warning string"


class Attempt(NamedTuple):
    """What one attempt gave."""

    text: str = ""
    confidence: float | None = None
    dpi: int = 0
    variant: str = ""
    psm: int = 0
    score: float = 0.0
    warning: str = ""


def lines_of(table: str) -> tuple[str, float | None]:
    """Text and mean confidence (one decimal) of a word table; no text without the five columns or any word."""
    head, *body = [line.split("\t") for line in re.split("\r\n|\r|\n", table) if line.strip()] or [[]]
    if not set(COLUMNS) <= set(head):
        return "", None
    at = {name: head.index(name) for name in COLUMNS}
    lines: dict[tuple, list[str]] = {}
    sure = []
    for cells in body:
        if len(cells) <= max(at.values()) or not cells[at["text"]].strip():
            continue
        lines.setdefault(tuple(cells[at[name]] for name in COLUMNS[:3]), []).append(cells[at["text"]].strip())
        sure += confidence_of(cells[at["conf"]])
    return "\n".join(map(" ".join, lines.values())), rounded(sum(sure) / len(sure), 1) if sure else None


def confidence_of(cell: str) -> list[float]:
    """A confidence, or none: what is no number, not a number or negative tells nothing."""
    try:
        value = float("nan" if "_" in cell else cell)
    except ValueError:
        return []
    return [value] if value >= 0 else []


def rounded(value: float, digits: int) -> float:
    """Half to even on the decimal form, as Spark's ``bround``."""
    return float(Decimal(repr(value)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN))


@lru_cache(maxsize=8)
def measured(text: str) -> tuple[float, ...]:
    """What a score owes to the text alone: for length, words and Cyrillic, and against unreadable characters and single letters."""
    sizes = [run.end() - run.start() for run in re.finditer("[A-Za-zА-Яа-яЁё]+", text)]
    letters, singles = sum(sizes), sizes.count(1)
    cyrillic = sum(run.end() - run.start() for run in re.finditer("[А-Яа-яЁё]+", text))
    return min(len(text), 2500) * 0.03, (len(sizes) - singles) * 0.8, (cyrillic / letters if letters else 0.0) * 35.0, text.count("�") * 8.0, singles / max(1, len(sizes)) * 40.0


def score_of(text: str, confidence: float | None, psm: int) -> float:
    """How good a recognised text looks: what ``operators.ocr.scored`` computes of a column."""
    bonus = S.PSM_BONUS.get(psm, 0.0)
    if not text:
        return bonus
    chars, words, cyrillic, replaced, singles = measured(text)
    return rounded(rounded(chars + words + (confidence or 0.0) * 2.0 + cyrillic - replaced - singles, 3) + bonus, 3)


def attempt(picture: np.ndarray, dpi: int, variant: str, psm: int, engine: engines.OcrEngine, settings: S.Settings) -> Attempt:
    """One attempt. In the best quality a word table is asked for, and plain text where it is without words; else plain text alone.

    An attempt that fails has no text, no score, and says why.
    """
    confidence = None
    try:
        text, wanted = "", settings.quality_mode != "max"
        if not wanted:
            text, confidence = lines_of(engine.table(picture, psm))
        if not text.strip():
            text = engine.text(picture, psm)
    except Exception as problem:
        return Attempt("", confidence, dpi, variant, psm, 0.0, str(problem).strip() or type(problem).__name__)
    text = re.sub("\r\n|\r", "\n", text).strip()
    return Attempt(text, confidence, dpi, variant, psm, score_of(text, confidence, psm))


def search(pictures: Iterable[tuple[int, object]], show: Callable, judge: Callable, settings: S.Settings) -> tuple[Attempt, int]:
    """The best attempt at ``pictures`` (resolution, picture), which are drawn one by one, and how many were made.

    The earliest of the highest score is best. From variants x segmentation modes attempts on, the search ends as soon as the best so far is
    confident and long enough. ``show(picture, variant)`` prepares a picture, ``judge(shown, dpi, variant, psm)`` tries it.
    """
    best, made = None, 0
    for dpi, picture in pictures:
        for variant in settings.variants:
            shown = show(picture, variant)
            for psm in settings.psm:
                found, made = judge(shown, dpi, variant, psm), made + 1
                best = found if best is None or found.score > best.score else best
                enough = made >= len(settings.variants) * len(settings.psm)
                if enough and (best.confidence or 0) >= S.STOP_CONFIDENCE and len(best.text) >= S.LOW_TEXT:
                    return best, made
    return best or Attempt(warning="OCR did not produce attempts."), made


def _row(found: Attempt, made: int) -> tuple:
    return (found.text, found.confidence, found.dpi, found.variant, found.psm, found.score, made, found.warning)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*names, *(c.split()[0] for c in CHOSEN.split(", "))]).astype({"confidence": "float64"})


def recognise(files: DataFrame, pages: DataFrame, pdf: Callable[[], engines.PdfEngine], ocr: Callable[[], engines.OcrEngine], settings: S.Settings) -> DataFrame:
    """doc_id, page_index, ``blank`` and the chosen attempt of ``pages`` (doc_id, page_index) of ``files`` (doc_id, content).

    The pages of a document are dealt over ``max_ocr_workers`` groups at most; a group is one row, opens its file once and is worked off in one
    task, so that no more pages of a document are recognised at a time. The caller filters pages first: no page with a good text
    layer is ever rendered. A page that looks blank takes no attempt; a resolution that cannot be rendered is
    passed over; a page without any keeps an empty attempt that says so.
    """
    group = F.pmod(F.col("page_index"), F.lit(settings.max_ocr_workers))
    grouped = pages.groupBy("doc_id", group.alias("part")).agg(F.sort_array(F.collect_list("page_index")).alias("pages")).join(files.select("doc_id", "content"), "doc_id")

    def drawn(render: Callable, page: int) -> Iterator[tuple[int, np.ndarray]]:
        for dpi in settings.dpi:
            try:
                yield dpi, render(page, dpi)
            except Exception:
                continue

    def one(render: Callable, page: int, engine: engines.OcrEngine) -> tuple:
        pictures = drawn(render, page)
        first = next(pictures, None)
        if first is None:
            return False, *_row(Attempt(warning=f"OCR page render failed: {page}"), 0)
        if engines.is_blank(first[1]):
            return True, *_row(Attempt(dpi=first[0]), 0)
        rest = (p for some in ((first,), pictures) for p in some)
        return False, *_row(*search(rest, engines.image_variant, lambda *a: attempt(*a, engine, settings), settings))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener, engine = pdf(), ocr()
        for batch in batches:
            for doc_id, numbers, content in zip(batch["doc_id"], batch["pages"], batch["content"], strict=True):
                try:
                    document = engines.opened(opener, content)
                except Exception as problem:  # a file that cannot be opened must not stop the others
                    rows = [(doc_id, page, False, *_row(Attempt(warning=str(problem)), 0)) for page in map(int, numbers)]
                else:
                    with closing(document):
                        rows = [(doc_id, page, *one(document.render, page, engine)) for page in map(int, numbers)]
                yield _frame(rows, ["doc_id", "page_index", "blank"])

    dealt = grouped.select("doc_id", "pages", "content").repartition("doc_id", "pages")
    return dealt.mapInPandas(work, f"doc_id long, page_index int, blank boolean, {CHOSEN}")


def recognise_pictures(pictures: DataFrame, opener: Callable[[], engines.PictureEngine], ocr: Callable[[], engines.OcrEngine], settings: S.Settings) -> DataFrame:
    """doc_id, number and the chosen attempt of ``pictures`` (doc_id, number, content) that may hold text; pictures that cannot be read give no row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pictures_of, engine = opener(), ocr()
        for batch in batches:
            for doc_id, number, content in zip(batch["doc_id"], batch["number"], batch["content"], strict=True):
                try:
                    image = pictures_of.grey(content)
                except Exception:  # a broken picture must not stop the others
                    continue
                if engines.is_candidate(image):
                    found = search([(0, image)], engines.image_variant, lambda *a: attempt(*a, engine, settings), settings)
                    yield _frame([(doc_id, number, *_row(*found))], ["doc_id", "number"])

    return pictures.select("doc_id", "number", "content").mapInPandas(work, f"doc_id long, number int, {CHOSEN}")


def search_texts(rows: DataFrame, answer: Callable[[int, str, int, int, str, int], tuple[str, float | None]], settings: S.Settings) -> DataFrame:
    """doc_id, attempt_no, attempt_count and score of the search over made-up attempts at ``rows`` (doc_id, text): ``answer(doc_id, text, number, dpi, variant, psm)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            # Texts are made one by one: of a batch only the bytes are held.
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), (t.as_py() for t in batch.column("text")), strict=True):
                numbers: dict[Attempt, int] = {}

                def judge(shown: str, dpi: int, variant: str, psm: int) -> Attempt:
                    said, sure = answer(doc_id, shown, len(numbers) + 1, dpi, variant, psm)  # noqa: B023
                    found = Attempt(said, sure, dpi, variant, psm, score_of(said, sure, psm))
                    numbers[found] = len(numbers) + 1  # noqa: B023
                    return found

                found, made = search(((dpi, text) for dpi in settings.dpi), lambda picture, variant: picture, judge, settings)
                out.append((doc_id, numbers[found], made, found.score))
            measured.cache_clear()
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "attempt_no", "attempt_count", "score"])

    return rows.select("doc_id", "text").mapInArrow(work, "doc_id long, attempt_no long, attempt_count long, score double")
