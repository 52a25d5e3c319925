"""From pages and blocks to documents: kinds, assembled Markdown, page reports and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import settings as S
from folioflow.functions import text as T
from folioflow.functions.cleanup import clean_markdown

NO_REPORT = f"array<{S.PAGE_REPORT}>"


def document_kind(ext: Column, pages: Column, ocr: Column) -> Column:
    """The kind of a file by its suffix and by how many of its pages (null: it has none) need recognition."""
    ext = F.lower(ext)
    return (
        F.when(ext == ".docx", S.DOCX)
        .when(ext != ".pdf", F.upper(F.regexp_replace(ext, r"\A\.+", "")))
        .when(pages.isNull() | (ocr == pages), S.SCAN)
        .when(ocr > 0, S.MIXED)
        .otherwise(S.TEXT_PDF)
    )


def document_kinds(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """``manifest`` (doc_id, ext) with doc_type, by how many pages (doc_id, page_text) need recognition. Files without pages stay."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(T.needs_ocr(F.col("page_text"))).alias("ocr"))
    kind = document_kind(F.col("ext"), F.col("pages"), F.col("ocr"))
    return manifest.join(counts, "doc_id", "left").select(*[manifest[c] for c in manifest.columns], kind.alias("doc_type"), F.col("pages").cast("int").alias("page_count"))


def page_entries(pages: DataFrame, settings: S.Settings) -> DataFrame:
    """doc_id, page_index, text and the page's report entry, of pages (doc_id, page_index, source, text, and of recognised ones confidence, psm, dpi, variant, score, attempt_count, attempt_warning)."""
    from folioflow.operators.ocr import reason

    ocr = F.col("source") == "ocr"
    noted = T.page_warning(F.col("text"), F.col("source"), F.col("confidence"), settings.quality_mode == "max")
    warning = F.when(F.col("source") == "blank", F.lit("Страница похожа на пустую.")).otherwise(T.join_notes(noted, F.coalesce("attempt_warning", F.lit(""))))
    why = reason(F.col("score"), F.col("confidence"), F.col("dpi"), F.col("psm"), F.col("variant"), F.col("attempt_count"))
    entry = F.struct(
        F.col("page_index").cast("int").alias("page_index"),
        F.col("source").alias("source"),
        F.length(T.strip(F.col("text"))).alias("char_count"),
        warning.alias("warning"),
        F.when(ocr, F.col("confidence")).alias("confidence"),
        F.when(ocr & (F.col("psm") != 0), F.col("psm")).cast("int").alias("psm"),
        F.when(ocr & (F.col("dpi") != 0), F.col("dpi")).cast("int").alias("dpi"),
        F.when(ocr, F.col("variant")).otherwise("").alias("variant"),
        F.when(ocr, F.col("attempt_count")).otherwise(0).cast("int").alias("attempt_count"),
        F.when(ocr, why).otherwise("").alias("selected_reason"),
    )
    markdown = T.page_markdown(F.col("page_index"), F.when(F.col("source") == "blank", "").otherwise(F.col("text")), settings.preserve_page_breaks)
    return pages.select("doc_id", "page_index", markdown.alias("markdown"), entry.alias("entry"))


def assembled(entries: DataFrame) -> DataFrame:
    """doc_id, markdown and page_report of every document, pages in order."""
    rows = F.array_sort(F.collect_list(F.struct("page_index", "markdown", "entry")))
    texts = F.filter(F.transform(rows, lambda r: r["markdown"]), lambda m: T.strip(m) != "")
    return entries.groupBy("doc_id").agg(T.strip(F.array_join(texts, "\n\n")).alias("markdown"), F.transform(rows, lambda r: r["entry"]).alias("page_report"))


def text_layer(pages: DataFrame, settings: S.Settings) -> DataFrame:
    """doc_id and markdown of documents read by their text layer alone; pages without text are left out."""
    some = pages.filter(T.strip(F.col("page_text")) != "")
    one = F.struct("page_index", T.page_markdown(F.col("page_index"), F.col("page_text"), settings.preserve_page_breaks).alias("markdown"))
    return some.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["markdown"]), "\n\n").alias("markdown"))


def first_text(*candidates: Column) -> Column:
    """The number (from 0) of the first candidate that holds text, null if none does."""
    out = F.lit(None).cast("int")
    for n, text in reversed(list(enumerate(candidates))):
        out = F.when(F.coalesce(T.strip(text), F.lit("")) != "", F.lit(n)).otherwise(out)
    return out


def missing_languages(settings: S.Settings, installed: Column) -> Column:
    """Languages asked for that the engine lacks, in the order asked."""
    return F.array_except(F.array(*[F.lit(x) for x in settings.ocr_languages]), installed)


def with_status(converted: DataFrame, settings: S.Settings, engine_path: str | None, installed: list[str]) -> DataFrame:
    """``converted`` (doc_type, method, raw_text, page_report, error) with quality, counts, status, warning and clean_markdown.

    Steps are in the order that decides which notes survive: too little text *replaces* the note on pages
    to review; an error replaces all; what concerns the engine is added to errors as well.
    """
    scanned = F.col("doc_type").isin(S.SCAN, S.MIXED)
    text = T.strip(T.newlines(F.coalesce("raw_text", F.lit(""))))
    base = converted.withColumn("text", text).withColumn("page_report", F.coalesce("page_report", F.array().cast(NO_REPORT)))
    error = F.when(F.coalesce("error", F.lit("")) != "", F.col("error")).when(F.col("text") == "", F.lit("Конвертер вернул пустой текст.")).otherwise("")
    base = base.withColumn("error", error).withColumn("quality", T.quality(F.col("text"), F.col("doc_type")))
    reviews = F.size(F.filter("page_report", lambda p: p["warning"] != ""))
    little = F.length("text") < S.LOW_TEXT
    fallback = scanned & ~F.contains(F.col("method"), F.lit("OCR"))
    bad = scanned & T.bad_russian(F.col("text"))
    started = F.when(little, F.lit("Мало извлечённого текста, нужно проверить вручную.")).when(reviews > 0, F.concat(F.lit("Есть элементы OCR для ручной проверки: "), reviews.cast("string"), F.lit("."))).otherwise("")
    noted = T.join_notes(
        started,
        F.when(fallback, F.lit("Скан обработан запасным методом, OCR нужно проверить.")).otherwise(""),
        F.when(bad, F.lit("Похоже на слабое распознавание русского текста.")).otherwise(""),
        F.col("quality.warning"),
    )
    failed = F.col("error") != ""
    lacking = [x for x in settings.ocr_languages if x not in installed]
    no_engine = scanned & F.lit(not engine_path)
    no_language = scanned & F.lit(bool(engine_path) and bool(lacking))
    warning = T.join_notes(
        F.when(failed, F.lit("Файл не удалось конвертировать.")).otherwise(noted),
        F.when(no_engine, F.lit("Tesseract OCR не найден; качество сканов может быть низким.")).otherwise(""),
        F.when(no_language, F.lit(f"В Tesseract не найдены языки OCR: {', '.join(lacking)}.")).otherwise(""),
    )
    review = (reviews > 0) | little | fallback | bad | (F.col("quality.status") != S.NORMAL) | no_engine | no_language
    status = F.when(failed, S.ERROR).when(review, S.REVIEW).otherwise(S.SUCCESS)
    count = lambda kind: F.size(F.filter("page_report", lambda p: p["source"] == kind))
    cleaned = T.let(clean_markdown(F.col("text")), lambda c: F.when(c != "", c).otherwise(F.col("text")))
    body = F.when(F.col("text") == "", F.concat(F.lit("Ошибка: "), F.col("error"))).otherwise(cleaned)
    return base.select(
        *[c for c in base.columns if c not in ("quality", "error", "raw_text", "text", "method")],
        F.when(F.coalesce("method", F.lit("")) == "", S.NOT_DONE).otherwise(F.col("method")).alias("method"),
        status.alias("status"),
        F.length("text").alias("char_count"),
        F.when(failed, 0.0).otherwise(F.col("quality.cyrillic_ratio")).alias("cyrillic_ratio"),
        F.when(failed, 0).otherwise(F.col("quality.replacement_count")).alias("replacement_count"),
        F.when(failed, S.NO_TEXT).otherwise(F.col("quality.status")).alias("quality_status"),
        count("text").alias("text_page_count"),
        count("ocr").alias("ocr_page_count"),
        count("blank").alias("blank_page_count"),
        count("docx-image").alias("docx_image_ocr_count"),
        warning.alias("warning"),
        "error",
        F.concat(body, F.lit("\n")).alias("clean_markdown"),
    )
