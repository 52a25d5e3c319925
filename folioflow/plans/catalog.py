"""Registered queries over the document operators. Their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import settings as S
from folioflow.functions import cleanup
from folioflow.functions import text as T
from folioflow.operators import conversion, docx, ocr, phrases, rasters, reports
from folioflow.plans import inputs, oracle
from folioflow.session import table
from folioflow.sources import docx_parts, manifest, recognition

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE = oracle.SQL
WANTED = ["the that", "and the of", "mit license", "tionre thand", "quality of des", "ing"]


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def _kind(doc_id) -> F.Column:
    return F.element_at(F.array(*[F.lit(k) for k in inputs.KINDS]), (doc_id % 4 + 1).cast("int"))


def _kinds(docs: DataFrame, paged: DataFrame) -> DataFrame:
    ext = F.when(F.col("doc_id") % 13 == 0, ".docx").when(F.col("doc_id") % 17 == 0, ".odt").otherwise(".PDF")
    return conversion.document_kinds(docs.select("doc_id", ext.alias("ext")), inputs.pages(paged)).select("doc_id", "doc_type", *_long("page_count"))


@query
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by language and quality."""
    judged = inputs.altered(spark, sf_dir).withColumn("q", T.quality(F.col("text"), _kind(F.col("doc_id"))))
    return judged.groupBy("lang", F.col("q.status").alias("quality_status"), F.col("q.warning").alias("warning")).agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"))


@query
def letter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of letters, Cyrillic letters, words, single letters and replacement characters."""
    text = F.col("text")
    counts = {"letters": T.letters(text), "cyrillic": T.cyrillic(text), "words": T.words(text), "singles": T.singles(text), "replacements": T.replacements(text)}
    return inputs.altered(spark, sf_dir).select("doc_id", *[c.cast("long").alias(n) for n, c in counts.items()])


@query
def page_ocr_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages need recognition."""
    text = T.strip(T.newlines(F.col("page_text")))
    return inputs.pages(inputs.altered(spark, sf_dir)).select("doc_id", F.col("page_index").cast("long").alias("page_index"), T.needs_ocr(F.col("page_text")).alias("needs_ocr"), T.bad_layer(text).alias("bad_layer"))


@query
def doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of documents by all their pages."""
    docs = inputs.altered(spark, sf_dir)
    return _kinds(docs, docs)


@query
def page_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer should know of a recognised page."""
    cut = inputs.pages(inputs.altered(spark, sf_dir))
    sure = F.when((F.col("doc_id") + F.col("page_index")) % 10 != 0, ((F.col("doc_id") * 31 + F.col("page_index") * 17) % 101).cast("double"))
    return cut.select("doc_id", F.col("page_index").cast("long").alias("page_index"), T.page_warning(F.col("page_text"), F.lit("ocr"), sure, True).alias("warning"))


@query
def bad_russian_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that look unlike Russian."""
    return inputs.altered(spark, sf_dir).select("doc_id", T.bad_russian(F.col("text")).alias("bad"))


@query
def dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of C12: words broken at line ends."""
    return inputs.marked_up(spark, sf_dir).select("doc_id", F.md5(cleanup.dehyphenate(F.col("text"))).alias("digest"))


@query
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-number lines and structural lines."""
    lines = inputs.marked_up(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    flags = lines.select("doc_id", cleanup.is_page_number(F.col("line")).alias("n"), cleanup.is_structural(F.col("line")).alias("s"))
    return flags.groupBy("doc_id").agg(F.count_if("n").alias("page_numbers"), F.count_if("s").alias("structural"), F.count("*").alias("lines"))


@query
def clean_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole clean-up."""
    return inputs.marked_up(spark, sf_dir).select("doc_id", F.md5(cleanup.clean_markdown(F.col("text"))).alias("digest"))


@query
def tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of word tables."""
    words = ocr.word_table(inputs.word_tables(table(spark, sf_dir, "documents", "doc_id", "text")), ["doc_id"])
    return ocr.recognised_lines(words, ["doc_id"]).select("doc_id", F.col("line_num").cast("long").alias("line_num"), "line")


@query
def tsv_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of word tables."""
    words = ocr.word_table(inputs.word_tables(table(spark, sf_dir, "documents", "doc_id", "text")), ["doc_id"])
    sure = ocr.confidence(F.col("conf"))
    return words.groupBy("doc_id").agg(F.sum(sure).alias("total"), F.count(sure).alias("words"))


@query
def attempt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the whole matrix of attempts, for all documents and whole texts; a text is measured once."""
    docs = inputs.altered(spark, sf_dir).select("doc_id", T.strip(F.col("text")).alias("text"))
    known = ocr.measures(F.col("text"))
    tried = inputs.sure_attempts(docs.select("doc_id", *[c.alias(n) for n, c in known.items()]))
    score = ocr.measured_score({n: F.col(n) for n in known}, F.col("confidence")) + ocr.psm_bonus(F.col("psm"))
    return tried.select("doc_id", *_long("attempt_no"), F.floor(score * 100 + 0.5).cast("long").alias("hundredths"))


@query
def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of attempts that exist as rows, with the early stop, by whole texts."""
    best = ocr.best_attempts(inputs.tried(inputs.altered(spark, sf_dir)), ["doc_id", "page_index"], 9)
    return best.select("doc_id", *_long("attempt_no", "attempt_count"), F.floor(F.col("score") * 100 + 0.5).cast("long").alias("hundredths"))


@query
def recognition_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the search over attempts as the conversion runs it, in the task and with the early stop, by whole texts."""
    text = T.strip(T.newlines(F.col("text"))).alias("text")
    found = recognition.search_texts(inputs.altered(spark, sf_dir).select("doc_id", text), inputs.made_up_answer, S.Settings())
    return found.select("doc_id", "attempt_no", "attempt_count", F.floor(F.col("score") * 100 + 0.5).cast("long").alias("hundredths"))


@query
def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under headings, in order."""
    made = conversion.text_layer(inputs.pages(inputs.altered(spark, sf_dir)), S.Settings())
    return made.select("doc_id", F.md5("markdown").alias("digest"), T.page_number(F.col("markdown")).cast("long").alias("first_page"))


@query
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, G6, G13 and the order of status rules."""
    rows = inputs.results(spark, sf_dir)
    return rows.select("doc_id", "doc_type", "method", "status", "warning", "quality_status", *_long("page_count", "char_count", "replacement_count", "text_page_count", "ocr_page_count", "blank_page_count"))


@query
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run."""
    return reports.run_totals(inputs.results(spark, sf_dir)).withColumn("mean_confidence", T.optional_float(F.col("mean_confidence")))


@query
def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the report tells of each file."""
    rows = reports.file_rows(inputs.results(spark, sf_dir))
    return rows.select("doc_id", "status", "quality_status", *_long("page_warnings", "ocr_page_count"), T.optional_float(F.col("mean_confidence")).alias("mean_confidence"))


@query
def run_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the report of a run, by its number."""
    return reports.run_report_lines(inputs.results(spark, sf_dir), inputs.RUN)


@query
def ocr_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the page-by-page report, by its number."""
    return reports.ocr_report_lines(inputs.results(spark, sf_dir), inputs.RUN)


@query
def review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to review."""
    return reports.review_list(inputs.results(spark, sf_dir)).select("doc_id", *_long("page_index"), "place", "warning")


@query
def page_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of every page."""
    return reports.page_lines(inputs.results(spark, sf_dir)).select("doc_id", *_long("page_index"), "line")


@query
def problem_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: notes on documents that need a look."""
    return reports.problem_notes(inputs.results(spark, sf_dir))


@query
def combined_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole section of every document in the combined text, as its digest and length."""
    sections = reports.document_sections(inputs.results(spark, sf_dir))
    return sections.select("doc_index", F.md5("section").alias("digest"), F.length("section").cast("long").alias("chars"))


@query
def phrase_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts hold which phrases."""
    found = phrases.phrase_recall(table(spark, sf_dir, "documents", "doc_id", "text"), WANTED)
    return found.select("doc_id", *_long("total", "found"), F.array_join("missing", "|").alias("missing"))


@query
def missing_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages asked for that are not there."""
    there = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("eng"))).otherwise(F.array(F.col("lang"), F.lit("rus")))
    docs = table(spark, sf_dir, "documents", "doc_id", "lang")
    return docs.select("doc_id", F.array_join(conversion.missing_languages(S.Settings(), there), ",").alias("missing"))


@query
def skip_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2, H1: how many of the files that the words of a text name are documents to convert."""
    folders = F.array(*[F.lit(x) for x in ("docs", "build", "markdown_result_1", ".converter_x", "Build", "runtime", "benchmark_result_2", "a")])
    ends = F.array(*[F.lit(x) for x in (".pdf", ".PDF", ".Docx", ".txt", ".d.pdf", "")])
    words = F.split("text", " ")
    paths = F.transform(words, lambda w, i: F.struct(F.element_at(folders, (F.length(w) % 8 + 1).cast("int")).alias("folder"), F.concat(F.when(i % 7 == 0, "~$").otherwise(""), w, F.element_at(ends, (i % 6 + 1).cast("int"))).alias("name")))
    kept = F.filter(paths, lambda x: manifest.wanted(x["name"], F.array(x["folder"])))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(paths).cast("long").alias("files"), F.size(kept).cast("long").alias("wanted"))


@query
def output_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output names before they are made unique, of whole texts."""
    odd = F.concat(F.lit(" ."), F.translate("text", "aeo", ':*"'), F.lit(". "))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(manifest.output_stem(F.array(F.lit("sub")), odd)).alias("stem"), F.md5(T.file_safe(odd, runs=True)).alias("part"))


@query
def docx_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of DOCX runs and table cells."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rough = F.replace(F.replace(F.col("text"), F.lit(", "), F.lit(" \t| ")), F.lit("\n"), F.lit("  \r\n "))
    return docs.select("doc_id", F.md5(T.docx_text(rough)).alias("run"), F.md5(T.table_cell(rough)).alias("cell"))


@query
def docx_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as DOCX files, read back: paragraphs, tables and notes in one Markdown text."""
    read = docx.docx_text(docx.docx_blocks(inputs.docx_files(spark, sf_dir)))
    return read.select("doc_id", F.md5("raw_text").alias("digest"), F.length("raw_text").cast("long").alias("chars"), (F.col("error") != "").alias("failed"))


@query
def docx_picture_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures that DOCX files refer to, by first reference."""
    found = docx.picture_places(docx_parts.references(inputs.docx_files(spark, sf_dir)))
    return found.select("doc_id", *_long("number"), "target")


@query
def raster_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark shares, blank pictures, candidates and the bounds of the contrast."""
    return rasters.measures(inputs.rasters(spark, sf_dir)).select("doc_id", "dark", "total", "blank", "candidate", *_long("low", "high"))


@query
def raster_greys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greys of all pictures."""
    return rasters.greys(inputs.rasters(spark, sf_dir))


@query
def phrase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts hold which of the phrases of a table: all items of ``benchmark``, by their sentences, in all documents."""
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    wanted = items.select("item_id", F.posexplode(F.split("text", r"[.\n]")).alias("n", "phrase")).select((F.col("item_id") * 1000 + F.col("n")).alias("phrase_id"), "phrase")
    found = phrases.recall_by_table(table(spark, sf_dir, "documents", "doc_id", "text"), wanted)
    return found.select("doc_id", "total", "found", "ids")


@query
def first_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several converters that gave text."""
    doc = F.col("doc_id")
    a = F.when(doc % 3 == 0, F.col("text")).otherwise(" \n ")
    b = F.when(doc % 4 == 0, F.col("text"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", conversion.first_text(a, b, F.when(doc % 5 == 0, "x")).cast("long").alias("converter"))


@query
def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read back out of the report of each document."""
    rows = reports.file_rows(inputs.results(spark, sf_dir))
    lines = [F.concat(F.lit(f"- {label}: "), value) for label, value in (
        ("символов извлечено", F.col("char_count").cast("string")), ("страниц OCR", F.when(F.col("ocr_page_count") > 0, F.col("ocr_page_count").cast("string")).otherwise("x")),
        ("страниц с замечаниями OCR", F.col("page_warnings").cast("string")), ("средняя уверенность OCR", F.replace(T.optional_float(F.col("mean_confidence")), F.lit("."), F.lit(","))),
    )]
    got = phrases.report_metrics(F.concat_ws("\n", F.lit("Итог:"), *lines))
    return rows.select("doc_id", *[got[c].cast("long").alias(c) for c in ("extracted_chars", "ocr_pages", "review_pages")], got["average_confidence"].alias("confidence"))


@query
def benchmark_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a run pass, in which one mode reads the texts as they are and the other altered?"""

    def mode(name: str, texts: DataFrame) -> DataFrame:
        found = phrases.phrase_recall(texts, WANTED)
        return found.agg(F.lit(name).alias("mode"), F.sum("found").alias("phrase_found"), (F.sum("found") > 0).alias("passed"), (F.count_if(F.col("found") == F.col("total")) > 0).alias("russian_passed"))

    return phrases.verdict(mode("max", table(spark, sf_dir, "documents", "doc_id", "text")).unionByName(mode("standard", inputs.altered(spark, sf_dir).select("doc_id", "text"))))
