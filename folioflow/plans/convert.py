"""The conversion of a folder: manifest to results, and what is written of them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import settings as S
from folioflow.functions import text as T
from folioflow.operators import conversion, docx, reports
from folioflow.sources import engines, manifest, recognition, sinks


def convert_pages(files: DataFrame, pages: DataFrame, pdf: Callable, recogniser: Callable, settings: S.Settings) -> DataFrame:
    """doc_id, markdown and page_report of PDF ``files`` (doc_id, content) with ``pages`` (doc_id, page_index, page_text).

    Pages are split by a filter before anything is rendered, and met again by a union.
    """
    good = pages.filter(~T.needs_ocr(F.col("page_text"))).select("doc_id", "page_index", F.lit("text").alias("source"), F.col("page_text").alias("text"))
    poor = pages.filter(T.needs_ocr(F.col("page_text"))).select("doc_id", "page_index")
    tried = recognition.recognise(files, poor, pdf, recogniser, settings)
    tried = tried.withColumn("source", F.when(F.col("blank"), "blank").otherwise("ocr")).drop("blank")
    rows = tried.unionByName(good, allowMissingColumns=True)
    return conversion.assembled(conversion.page_entries(rows, settings))


def convert_pictures(files: DataFrame, opener: Callable, recogniser: Callable, settings: S.Settings) -> DataFrame:
    """doc_id, blocks and page_report of the embedded pictures with text of DOCX ``files`` (doc_id, content)."""
    best = recognition.recognise_pictures(docx.docx_pictures(files), opener, recogniser, settings)
    kept = docx.picture_sections(best.withColumn("source", F.lit("ocr"))).persist()
    entries = conversion.page_entries(kept, settings).select("doc_id", "page_index", F.col("entry").withField("source", F.lit("docx-image")).alias("entry"))
    rows = F.array_sort(F.collect_list(F.struct("page_index", "block", "entry")))
    found = kept.select("doc_id", "page_index", "block").join(entries, ["doc_id", "page_index"]).groupBy("doc_id").agg(rows.alias("rows"))
    return found.select("doc_id", F.col("rows.block").alias("blocks"), F.col("rows.entry").alias("page_report"))


def convert_folder(
    spark: SparkSession, folder: str, settings: S.Settings, pdf: Callable = engines.Pdfium, recogniser: Callable | None = None, info: engines.EngineInfo | None = None,
    pictures: Callable = engines.Pillow, converter: Callable = engines.third_party_markdown,
) -> DataFrame:
    """Results of all documents of a folder, with doc_index, name, source, output_name and clean_markdown."""
    info = info if info is not None else engines.common_info(engines.probe_executors(spark, settings))
    files = manifest.manifest(spark, folder)
    data = manifest.contents(files).drop("path").persist()
    is_docx = F.lower("ext") == ".docx"
    pdfs = data.join(files.filter(~is_docx).select("doc_id"), "doc_id", "left_semi")
    pages = engines.pdf_pages(pdfs, pdf).persist()
    kinds = conversion.document_kinds(files, pages)
    docx_files = data.join(files.filter(is_docx).select("doc_id"), "doc_id", "left_semi")
    own = docx.docx_text(docx.docx_blocks(docx_files)).withColumn("method", F.lit(S.DOCX_METHOD))
    own = own.withColumn("page_report", F.lit(None).cast(conversion.NO_REPORT))
    layer = conversion.text_layer(pages, settings).select("doc_id", F.col("markdown").alias("raw_text"), F.lit(S.LAYER_METHOD).alias("method"), F.lit("").alias("error"))
    scans = kinds.filter(F.col("doc_type").isin(S.SCAN, S.MIXED)).select("doc_id")
    if recogniser is not None and info.path:
        own = docx.with_pictures(own.drop("page_report"), convert_pictures(docx_files, pictures, recogniser, settings))
        # Without a language that is asked for, scans go to the other converters.
        able = set(settings.ocr_languages) <= set(info.languages)
        paged = convert_pages(pdfs, pages.join(scans, "doc_id", "left_semi").filter(F.lit(able)), pdf, recogniser, settings)
        paged = paged.select("doc_id", F.col("markdown").alias("raw_text"), F.lit(S.PAGEWISE).alias("method"), F.lit("").alias("error"), "page_report")
        own = own.unionByName(paged.filter("raw_text <> ''"))
    own = own.unionByName(layer.join(scans, "doc_id", "left_anti"), allowMissingColumns=True).persist()
    lacking = kinds.select("doc_id", "ext", "doc_type").join(own.filter(T.strip(F.col("raw_text")) != "").select("doc_id"), "doc_id", "left_anti")
    others = engines.other_converters(lacking.join(data.select("doc_id", "content"), "doc_id"), converter).persist()
    # A scan's text layer is the last resort.
    late = layer.join(scans, "doc_id", "left_semi").select("doc_id", F.col("raw_text").alias("layer_text"))
    joined = kinds.join(own, "doc_id", "left").join(others, "doc_id", "left").join(late, "doc_id", "left")
    mine, other, last = (T.strip(F.coalesce(F.col(c), F.lit(""))) != "" for c in ("raw_text", "other_text", "layer_text"))
    told = F.concat_ws("; ", F.when(F.col("error") != "", F.concat("method", F.lit(": "), "error")), F.nullif(F.col("other_error"), F.lit("")))
    joined = joined.select(
        *kinds.columns, "page_report", F.when(mine, F.col("raw_text")).when(other, F.col("other_text")).when(last, F.col("layer_text")).alias("raw_text"),
        F.when(mine, F.col("method")).when(other, F.col("other_method")).when(last, S.LAYER_METHOD).otherwise("").alias("method"), F.when(mine | other | last, "").otherwise(told).alias("error"),
    )
    named = joined.withColumn("doc_index", F.col("doc_id") + 1).withColumn("source", F.col("path"))
    return conversion.with_status(named, settings, info.path, list(info.languages))


def write_results(results: DataFrame, folder: str, settings: S.Settings, started: dt.datetime, info: engines.EngineInfo | None = None, finished: dt.datetime | None = None) -> Path:
    """Write Markdown files, notes on problems, the combined text and the reports; returns the result folder. Executors write all of it."""
    results = results.persist()
    top = manifest.result_folder(folder, started)
    clean, problems = top / "01_markdown", top / "02_problem_files"
    clean.mkdir()
    sinks.write_files(results.select(F.col("output_name").alias("name"), F.col("clean_markdown").alias("text")), str(clean))
    notes = reports.problem_notes(results).join(results.select("doc_id", "output_name"), "doc_id").select(F.col("output_name").alias("name"), F.col("note").alias("text"))
    if not notes.isEmpty():
        problems.mkdir()
        sinks.write_files(notes, str(problems))
    sinks.write_lines(reports.combined_lines(results, settings.preserve_page_breaks), str(top / "00_ALL_DOCUMENTS.md"))
    info = info or engines.EngineInfo()
    run = reports.Run(folder, str(top), started, finished or dt.datetime.now(started.tzinfo), settings, info.path, info.version, info.languages, info.data)
    sinks.write_lines(reports.run_report_lines(results, run), str(top / "REPORT.txt"))
    sinks.write_lines(reports.ocr_report_lines(results, run), str(top / "OCR_REPORT.txt"))
    results.unpersist()
    return top
