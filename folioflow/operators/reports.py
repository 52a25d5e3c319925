"""Reports of a run: totals, a block per file, pages to review, notes on problems, and all documents in one text."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow import settings as S
from folioflow.functions import text as T
from folioflow.session import materialise


@dataclass(frozen=True)
class Run:
    """What the reports tell of a run beside its results."""

    folder: str
    result: str
    started: dt.datetime
    finished: dt.datetime
    settings: S.Settings
    engine: str | None = None
    version: str | None = None
    languages: tuple[str, ...] = ()
    data: str | None = None


#: Documents whose lines are counted together before they are numbered.
COUNTED_TOGETHER = 4096
TITLE, OCR_TITLE = "Отчёт о конвертации документов", "Постраничный OCR-отчет"
TOTALS = (("documents", "документов обработано"), ("succeeded", "успешно"), ("to_review", "требует проверки"), ("failed", "ошибки"), ("pages", "страниц PDF"), ("ocr_pages", "страниц OCR"), ("docx_images", "изображений DOCX распознано OCR"), ("text_pages", "страниц прочитано текстовым слоем"), ("blank_pages", "пустых/почти пустых страниц"), ("page_warnings", "страниц с замечаниями OCR"), ("image_warnings", "изображений DOCX с замечаниями OCR"), ("chars", "символов извлечено"))


def _warned(kind: str) -> Column:
    """Number of a document's report entries with a warning, of DOCX images or of pages."""
    image = kind == "docx-image"
    return F.size(F.filter("page_report", lambda p: (p["warning"] != "") & ((p["source"] == "docx-image") == F.lit(image))))


def mean_confidence() -> Column:
    """A document's mean page confidence, one decimal, null if no page has any."""
    values = F.filter(F.transform("page_report", lambda p: p["confidence"]), lambda c: c.isNotNull())
    return F.when(F.size(values) > 0, F.bround(F.aggregate(values, F.lit(0.0), lambda a, c: a + c) / F.size(values), 1))


def total_columns() -> list[Column]:
    """Aggregates of the totals over all documents, each one a partial sum; no entry is exploded."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long")
    sures = F.filter(F.transform("page_report", lambda p: p["confidence"]), lambda c: c.isNotNull())
    sure, known = F.sum(F.aggregate(sures, F.lit(0.0), lambda a, c: a + c)), F.sum(F.size(sures))
    sums = (("page_count", "pages"), ("ocr_page_count", "ocr_pages"), ("docx_image_ocr_count", "docx_images"), ("text_page_count", "text_pages"), ("blank_page_count", "blank_pages"))
    return [
        F.count(F.lit(1)).alias("documents"),
        *[F.count_if(F.col("status") == s).alias(name) for s, name in ((S.SUCCESS, "succeeded"), (S.REVIEW, "to_review"), (S.ERROR, "failed"))],
        *[total(F.col(c)).alias(name) for c, name in sums], total(_warned("page")).alias("page_warnings"), total(_warned("docx-image")).alias("image_warnings"), total(F.col("char_count")).alias("chars"),
        F.bround(F.when(known > 0, sure / known), 1).alias("mean_confidence"),
    ]


def run_totals(results: DataFrame) -> DataFrame:
    """One row of totals over all documents."""
    return results.agg(*total_columns())


def file_rows(results: DataFrame) -> DataFrame:
    """A row per document with what its block of the report tells."""
    return results.select(
        "doc_id", "status", "doc_type", "method", "char_count", "quality_status", "ocr_page_count", "text_page_count", "blank_page_count", "docx_image_ocr_count",
        _warned("page").alias("page_warnings"), _warned("docx-image").alias("image_warnings"), mean_confidence().alias("mean_confidence"), "warning", "error",
    )


def review_list(results: DataFrame) -> DataFrame:
    """doc_id, page_index, place, warning of every page or image that needs review."""
    noted = results.select("doc_id", F.explode(F.filter("page_report", lambda p: p["warning"] != "")).alias("p"))
    return noted.select("doc_id", F.col("p.page_index").alias("page_index"), T.entry_place(F.col("p")).alias("place"), F.col("p.warning").alias("warning"))


def page_lines(results: DataFrame) -> DataFrame:
    """doc_id, page_index, line: the line of every entry in the page-by-page report."""
    rows = results.select("doc_id", F.explode("page_report").alias("p"))
    p = F.col("p")
    return rows.select("doc_id", p["page_index"].alias("page_index"), entry_line(p).alias("line"))


def problem_notes(results: DataFrame) -> DataFrame:
    """doc_id and note of every document that is not a success. ``results`` has name and source."""
    none = lambda c, word: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(word))
    note = F.concat_ws(
        "\n", F.concat(F.lit("# Требует проверки: "), F.col("name")), F.lit(""), F.concat(F.lit("- Исходный файл: `"), F.col("source"), F.lit("`")),
        F.concat(F.lit("- Тип: "), F.col("doc_type")), F.concat(F.lit("- Метод: "), none("method", S.NOT_DONE)), F.concat(F.lit("- Статус: "), F.col("status")),
        F.concat(F.lit("- Предупреждение: "), none("warning", "нет")), F.concat(F.lit("- Ошибка: "), none("error", "нет")), F.lit(""),
        F.lit("Проверьте исходный документ вручную, особенно если это бумажный скан."), F.lit(""),
    )
    return results.filter(F.col("status") != S.SUCCESS).select("doc_id", note.alias("note"))


def document_sections(results: DataFrame, page_breaks: bool = False) -> DataFrame:
    """doc_index and section of every document in the combined text. ``results`` has doc_index, name, source and clean_markdown."""
    mode = "сохранены" if page_breaks else "обычный режим"
    section = F.concat_ws(
        "\n", F.concat(F.lit("\n\n---\n\n# Документ "), F.col("doc_index").cast("string"), F.lit(": "), F.col("name")), F.lit(""), F.concat(F.lit("- Тип: "), F.col("doc_type")),
        F.concat(F.lit("- Метод: "), F.col("method")), F.concat(F.lit("- Статус: "), F.col("status")), F.concat(F.lit("- Качество: "), F.col("quality_status")),
        F.concat(F.lit("- Исходный файл: `"), F.col("source"), F.lit("`")), F.lit(f"- Границы страниц: {mode}"), F.lit(""), T.strip(F.col("clean_markdown")),
    )
    # Not a filter: it would be handed down and make the text twice.
    there = F.filter(F.array(F.when(F.col("clean_markdown").isNotNull(), section)), lambda x: x.isNotNull())
    return results.select("doc_index", F.explode(there).alias("section"))


COMBINED_HEAD = "# Все документы\n\nИсточник: очищенные Markdown-файлы из папки `01_markdown`.\nДля юридически важных мест сверяйте OCR-сканы с оригинальными PDF.\n"
NO_PAGES = "OCR не выполнялся: в обработанных файлах не было PDF-сканов, смешанных PDF или подходящих изображений DOCX."


def numbered(blocks: DataFrame) -> DataFrame:
    """line_no (from 1) and line of ``blocks`` (section, doc_index, lines): by section, then document, then place.

    Numbers are prefix sums in two steps: over groups of COUNTED_TOGETHER neighbouring documents, and within each group. No
    list of all lines or documents is gathered; only one row per group passes through one task.
    """
    place = F.col("section") * (1 << 40) + F.coalesce("doc_index", F.lit(0))
    rows = blocks.select(place.alias("place"), F.floor(place / COUNTED_TOGETHER).alias("grp"), "lines")
    sizes = rows.groupBy("grp").agg(F.sum(F.size("lines")).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum(F.size("lines")).over(Window.partitionBy("grp").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("own", own).join(sizes.select("grp", before.alias("before")), "grp")
    return placed.select("own", "before", F.posexplode("lines").alias("at", "line")).select((F.col("before") + F.col("own") + F.col("at") + 1).alias("line_no"), "line")


def _fixed(*lines: str) -> Column:
    return F.array(*[F.lit(x) for x in lines])


def _told(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value.cast("string"))


def _or(column: Column, other: str) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(other))


def _times(run: Run) -> list[Column]:
    start, end = (F.lit(t).cast("timestamp_ntz") for t in (run.started.isoformat(), run.finished.isoformat()))
    return [_told("Создан: ", F.date_format(end, "yyyy-MM-dd HH:mm:ss")), _told("Время обработки: ", T.duration(start, end))]


def _told_of(results: DataFrame) -> DataFrame:
    """What both reports tell of ``results``, written once: totals, first document and lines read it, and none of them makes the texts again."""
    wanted = ("doc_index", "name", "output_name", "status", "doc_type", "method", "page_count", "page_report", "char_count", "quality_status", "ocr_page_count", "text_page_count", "blank_page_count", "docx_image_ocr_count", "warning", "error")
    return materialise(results.select(*[c for c in wanted if c in results.columns]), "report")


def run_report_lines(results: DataFrame, run: Run) -> DataFrame:
    """line_no and line of the report of a run: totals, then a block for every document. ``results`` has doc_index, name and output_name."""
    results = _told_of(results)
    created, took = _times(run)
    languages = ", ".join(run.languages) or "языки не определены"
    found = f"найден{f', версия {run.version}' if run.version else ''} ({languages})" if run.engine else "не найден"
    s = run.settings
    head = F.concat(
        _fixed(TITLE, ""), F.array(created, F.lit(f"Исходная папка: {run.folder}"), F.lit(f"Папка результата: {run.result}"), took), _fixed("", "Итог:"),
        F.array(*[_told(f"- {label}: ", F.col(name)) for name, label in TOTALS]),
        _fixed(
            f"- Tesseract OCR: {found}", f"- Tesseract path: {run.engine or 'не найден'}", f"- tessdata: {run.data or 'не определено'}", f"- OCR языки: {s.language_argument}",
            f"- режим качества OCR: {s.quality_mode}", f"- максимум параллельных OCR-страниц: {s.max_ocr_workers}", f"- границы страниц в Markdown: {'сохраняются' if s.preserve_page_breaks else 'обычный режим'}",
        ),
        F.array(_told("- средняя уверенность OCR: ", T.optional_float(F.col("mean_confidence")))), _fixed("", "Файлы:"),
    )
    top = run_totals(results).select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("doc_index"), head.alias("lines"))
    first = results.agg(F.min("doc_index").alias("first"))
    block = F.array(
        F.concat(F.col("doc_index").cast("string"), F.lit(". "), F.col("name")), _told("   Статус: ", F.col("status")), _told("   Тип: ", F.col("doc_type")), _told("   Метод: ", F.col("method")),
        _told("   Markdown: 01_markdown/", F.col("output_name")), _told("   Страниц: ", T.optional_int(F.col("page_count"))), _told("   OCR страниц: ", F.col("ocr_page_count")),
        _told("   Изображений DOCX распознано OCR: ", F.col("docx_image_ocr_count")), _told("   Текстовый слой: ", F.col("text_page_count")), _told("   Пустые страницы: ", F.col("blank_page_count")),
        _told("   Страниц с замечаниями OCR: ", _warned("page")), _told("   Изображений DOCX с замечаниями OCR: ", _warned("docx-image")), _told("   Средняя уверенность OCR: ", T.optional_float(mean_confidence())),
        _told("   Символов: ", F.col("char_count")), _told("   Качество: ", F.col("quality_status")), _told("   Предупреждение: ", _or(F.col("warning"), "нет")), _told("   Ошибка: ", _or(F.col("error"), "нет")),
    )
    # An empty line stands between the blocks.
    lines = F.when(F.col("doc_index") > F.col("first"), F.concat(_fixed(""), block)).otherwise(block)
    files = results.crossJoin(F.broadcast(first)).select(F.lit(1).alias("section"), F.col("doc_index").cast("long").alias("doc_index"), lines.alias("lines"))
    return numbered(top.unionByName(files))


def entry_line(p: Column) -> Column:
    """The line of a page or picture in the page-by-page report."""
    return F.concat(F.lit("- "), T.entry_place(p), F.lit(": "), T.source_label(p["source"]), F.lit(", символов: "), p["char_count"].cast("string"), F.lit(", "), T.entry_details(p), F.lit(", замечание: "), _or(p["warning"], "нет"))


def ocr_report_lines(results: DataFrame, run: Run) -> DataFrame:
    """line_no and line of the page-by-page report: what to review, then a block for every document with pages."""
    results = _told_of(results)
    paged = results.filter(F.size("page_report") > 0)
    noted = F.filter("page_report", lambda p: p["warning"] != "")
    some = results.agg(F.coalesce(F.max(F.size("page_report")), F.lit(0)).alias("pages"), F.coalesce(F.max(F.size(noted)), F.lit(0)).alias("notes"), F.min(F.when(F.size("page_report") > 0, F.col("doc_index"))).alias("first"))
    created, took = _times(run)
    start = F.concat(_fixed(OCR_TITLE, ""), F.array(created, took), _fixed(""), F.when(F.col("pages") == 0, _fixed(NO_PAGES)).otherwise(_fixed("Страницы и изображения для ручной проверки:")))
    head = some.select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("doc_index"), start.alias("lines"))
    index = F.col("doc_index").cast("long").alias("doc_index")
    review = paged.select(F.lit(1).alias("section"), index, F.transform(noted, lambda p: F.concat(F.lit("- "), F.col("name"), F.lit(", "), T.entry_place(p), F.lit(": "), p["warning"])).alias("lines")).filter(F.size("lines") > 0)
    middle = some.filter("pages > 0").select(F.lit(2).alias("section"), F.lit(0).cast("long").alias("doc_index"), F.when(F.col("notes") == 0, _fixed("- нет", "")).otherwise(_fixed("")).alias("lines"))
    block = F.concat(
        F.when(F.col("doc_index") > F.col("first"), _fixed("")).otherwise(F.array().cast("array<string>")),
        F.array(
            _told("Файл: ", F.col("name")), _told("Тип: ", F.col("doc_type")), _told("Метод: ", F.col("method")), _told("Страниц: ", T.optional_int(F.col("page_count"))), _told("OCR страниц: ", F.col("ocr_page_count")),
            _told("Изображений DOCX распознано OCR: ", F.col("docx_image_ocr_count")), _told("Текстовый слой: ", F.col("text_page_count")), _told("Пустые страницы: ", F.col("blank_page_count")), F.lit(""), F.lit("Страницы и изображения:"),
        ),
        F.transform("page_report", entry_line),
    )
    files = paged.crossJoin(F.broadcast(some)).select(F.lit(3).alias("section"), index, block.alias("lines"))
    return numbered(head.unionByName(review).unionByName(middle).unionByName(files))


def combined_lines(results: DataFrame, page_breaks: bool = False) -> DataFrame:
    """line_no and line of the combined text: its head, and the section of every document as one."""
    sections = document_sections(results, page_breaks).select(F.col("doc_index").cast("long").alias("line_no"), F.col("section").alias("line"))
    return results.sparkSession.createDataFrame([(-(1 << 40), COMBINED_HEAD)], "line_no long, line string").unionByName(sections)
