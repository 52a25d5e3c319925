"""Constants, settings and schemas of document conversion."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Thresholds, label texts and OCR matrices that results depend on.
EXTENSIONS = (".pdf", ".docx")
LOW_TEXT = 400
LAYER_MIN_CHARS = 40
LAYER_MIN_LETTERS = 60
LAYER_BAD_SINGLES = 0.65
LAYER_BAD_CYRILLIC = 0.25
SCAN_LOW_CYRILLIC = 0.35
SCAN_MIN_LETTERS = 200
PAGE_MIN_LETTERS = 100
BLANK_DARK_SHARE = 0.01
DARK_BELOW = 245
CONTRAST_CUT = 1
WHITE_ABOVE = 180
MAX_WORKERS = 4
MAX_IMAGE_PIXELS = 250_000_000
SKIPPED_DIRS = (".venv", "__pycache__", "build", "dist", "runtime", "tessdata")
SKIPPED_PREFIXES = ("markdown_result_", "benchmark_result_", ".converter_")
DPI = {"standard": (216,), "max": (300, 250, 216)}
PSM = {"standard": (6,), "max": (6, 4, 11)}
VARIANTS = {"standard": ("contrast_sharp",), "max": ("gray", "contrast_sharp", "binary")}
REVIEW_CONFIDENCE = 65.0
STOP_CONFIDENCE = 88.0
PSM_BONUS = {6: 8.0, 4: 2.0, 11: 0.0}
IMAGE_MIN_WIDTH, IMAGE_MIN_HEIGHT, IMAGE_MIN_PIXELS, IMAGE_MIN_LETTERS = 320, 160, 120_000, 20

DOCX, SCAN, MIXED, TEXT_PDF = "DOCX", "PDF-скан", "PDF смешанный", "PDF с текстом"
SUCCESS, REVIEW, ERROR = "успешно", "требует проверки", "ошибка"
NO_TEXT, NORMAL, CHECK = "нет текста", "норма", "проверить"
PAGEWISE, DOCX_METHOD, LAYER_METHOD, NOT_DONE = "Постранично: текст+OCR", "Встроенное чтение DOCX + OCR изображений", "PDFium text", "не выполнено"
SOURCE_LABELS = {"ocr": "OCR", "text": "текстовый слой", "blank": "пустая/почти пустая", "docx-image": "OCR изображения DOCX"}

PAGE_REPORT = (
    "struct<page_index:int,source:string,char_count:int,warning:string,confidence:double,psm:int,dpi:int,"
    "variant:string,attempt_count:int,selected_reason:string>"
)

@dataclass(frozen=True)
class Settings:
    """What a run is asked to do."""

    ocr_languages: tuple[str, ...] = ("rus", "eng")
    max_ocr_workers: int = MAX_WORKERS
    quality_mode: str = "max"
    tesseract_path: str | None = None
    tessdata_dir: str | None = None
    preserve_page_breaks: bool = False

    def __post_init__(self) -> None:
        if self.quality_mode not in DPI:
            raise ValueError(f"unknown quality mode: {self.quality_mode}")

    @property
    def language_argument(self) -> str:
        return "+".join(self.ocr_languages)

    @property
    def dpi(self) -> tuple[int, ...]:
        return DPI[self.quality_mode]

    @property
    def psm(self) -> tuple[int, ...]:
        return PSM[self.quality_mode]

    @property
    def variants(self) -> tuple[str, ...]:
        return VARIANTS[self.quality_mode]


def parse_languages(value: str) -> tuple[str, ...]:
    """Language codes from text such as ``rus+eng``: no repeats, order kept; ValueError for none or a bad one."""
    codes = tuple(dict.fromkeys(code for code in re.split(r"[+,; ]+", value) if code))
    bad = [code for code in codes if not re.fullmatch(r"[A-Za-z0-9_-]+", code)]
    if bad or not codes:
        raise ValueError(f"bad OCR languages: {value!r}")
    return codes


def parse_workers(value: str) -> int:
    """A number of workers from 1 to MAX_WORKERS."""
    workers = int(value)
    if not 1 <= workers <= MAX_WORKERS:
        raise ValueError(f"workers must be 1 to {MAX_WORKERS}")
    return workers
