"""Inputs of the registered queries: the documents table, altered so that every rule has something to act on."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import settings as S
from folioflow.functions import text as T
from folioflow.operators import conversion, reports
from folioflow.session import table
from folioflow.sources import docx_parts

#: What reports tell of a run beside its results.
RUN = reports.Run("/in", "/out", dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 6, 10), S.Settings(), "/bin/engine", "5.3", ("rus", "eng"))
LATIN, RUSSIAN = "abcdefghijklmnopqrstuvwxyz", "абцдефгхижклмнопярстувщызэ"
PAGE_LINES = 8
KINDS = (S.DOCX, S.SCAN, S.MIXED, S.TEXT_PDF)


def altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang and text: every third in Cyrillic, every seventh with spaced letters, every eleventh with U+FFFD."""
    doc, text = F.col("doc_id"), F.col("text")
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    docs = docs.withColumn("text", F.when(doc % 3 == 0, F.translate(text, LATIN, RUSSIAN)).otherwise(text))
    docs = docs.withColumn("text", F.when(doc % 7 == 0, F.regexp_replace(text, "(.)", "$1 ")).otherwise(text))
    return docs.withColumn("text", F.when(doc % 11 == 0, F.replace(text, F.lit("e"), F.lit("�"))).otherwise(text))


def marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text with hyphens at line ends, page numbers, empty lines and lists."""
    doc, text = F.col("doc_id"), F.col("text")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    docs = docs.withColumn("text", F.replace(text, F.lit("tion"), F.lit("ti-\non")))
    docs = docs.withColumn("text", F.when(doc % 5 == 0, F.replace(text, F.lit(". "), F.lit(".\n\nстр. 12\n"))).otherwise(text))
    return docs.withColumn("text", F.when(doc % 4 == 0, F.replace(text, F.lit(", "), F.lit("\n- "))).otherwise(text))


def pages(docs: DataFrame) -> DataFrame:
    """doc_id, page_index and page_text: eight lines a page, cut inside the row."""
    lines = docs.select("doc_id", F.split("text", "\n", -1).alias("lines"))
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size("lines") / PAGE_LINES).cast("int") - 1), lambda i: F.array_join(F.slice("lines", i * PAGE_LINES + 1, PAGE_LINES), "\n"))
    return lines.select("doc_id", F.posexplode(cut).alias("at", "page_text")).select("doc_id", (F.col("at") + 1).alias("page_index"), "page_text")


def sure_attempts(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, page_index and the matrix of attempts with made-up confidences."""
    from folioflow.operators.ocr import attempt_matrix

    settings = S.Settings()
    tried = attempt_matrix(docs.select("*", F.lit(1).alias("page_index")), settings)
    number = F.array_position(F.array(*[F.lit(v) for v in settings.variants]), F.col("variant"))
    sure = ((F.col("doc_id") * 31 + F.col("dpi") * 7 + F.col("psm") * 13 + number * 17) % 101).cast("double")
    return tried.withColumn("confidence", sure)


def made_up_answer(doc_id: int, text: str, number: int, dpi: int, variant: str, psm: int) -> tuple[str, float]:
    """What ``tried`` has of one attempt."""
    place = S.VARIANTS["max"].index(variant) + 1
    return ("" if (doc_id + number) % 5 == 0 else text), float((doc_id * 31 + dpi * 7 + psm * 13 + place * 17) % 101)


def tried(docs: DataFrame) -> DataFrame:
    """doc_id, page_index and the matrix of attempts, each with the measures of the whole text, or of none in every fifth, and its score."""
    from folioflow.operators import ocr

    text = docs.select("doc_id", T.strip(T.newlines(F.col("text"))).alias("text"))
    known = ocr.measures(F.col("text"))
    rows = sure_attempts(text.select("doc_id", *[c.alias(n) for n, c in known.items()]))
    seen = rows.withColumn("chars", F.when((F.col("doc_id") + F.col("attempt_no")) % 5 == 0, 0).otherwise(F.col("chars")))
    return seen.select("doc_id", "page_index", "attempt_no", "confidence", "chars", ocr.final_score({n: F.col(n) for n in known}, F.col("confidence"), F.col("psm")).alias("score"))


def word_tables(docs: DataFrame) -> DataFrame:
    """doc_id and tsv: the words of a text as a recogniser would list them, seven to a line."""
    words = F.filter(F.split("text", r"[\s]+"), lambda w: w != "")
    head = F.lit("level\tblock_num\tpar_num\tline_num\tconf\ttext")
    row = F.transform(words, lambda w, i: F.concat_ws("\t", F.lit("5"), F.lit("1"), F.floor(i / 70).cast("string"), F.floor(i / 7).cast("string"), ((F.col("doc_id") * 7 + i * 13) % 103 - 2).cast("string"), w))
    return docs.select("doc_id", F.concat_ws("\n", head, F.array_join(row, "\n")).alias("tsv"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion results of the altered documents, each page recognised in one attempt where it needs to be."""
    settings = S.Settings(quality_mode="standard")
    cut = pages(altered(spark, sf_dir)).select("doc_id", "page_index", T.strip(F.col("page_text")).alias("text"), T.needs_ocr(F.col("page_text")).alias("need"))
    need = F.col("need")
    source = F.when(~need, "text").when(F.col("text") == "", "blank").otherwise("ocr")
    sure = F.when(need & ((F.col("doc_id") + F.col("page_index")) % 10 != 0), ((F.col("doc_id") * 31 + F.col("page_index") * 17) % 101).cast("double"))
    rows = cut.select("doc_id", "page_index", source.alias("source"), "text", sure.alias("confidence"), F.lit(6).alias("psm"), F.lit(216).alias("dpi"), F.lit("contrast_sharp").alias("variant"), F.lit(1.0).alias("score"), F.lit(1).alias("attempt_count"), F.lit("").alias("attempt_warning"))
    files = table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.lit(".pdf").alias("ext"))
    # One pass over the pages: their report entries tell the kind of a document too.
    joined = files.join(conversion.assembled(conversion.page_entries(rows, settings)), "doc_id", "left")
    count = F.size("page_report")
    poor = F.size(F.filter("page_report", lambda p: p["source"] != "text"))
    joined = joined.withColumn("page_count", F.when(F.col("page_report").isNotNull(), count))
    joined = joined.withColumn("doc_type", conversion.document_kind(F.col("ext"), F.col("page_count"), poor))
    layer = F.col("doc_type") == S.TEXT_PDF
    read = joined.select(
        "doc_id", "doc_type", "page_count", F.col("markdown").alias("raw_text"), F.when(~layer, F.col("page_report")).alias("page_report"),
        F.when(layer, S.LAYER_METHOD).otherwise(S.PAGEWISE).alias("method"), F.lit("").alias("error"),
    )
    done = conversion.with_status(read, settings, "engine", ["rus", "eng"])
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return done.withColumn("name", name).withColumn("source", F.concat(F.lit("/in/"), name)).withColumn("doc_index", F.col("doc_id") + 1).withColumn("output_name", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")))


#: What the pictures of ``docx_files`` are: id, target, external. One id stands twice, one target is not there.
LINKS = (("r0", "media/a.png", False), ("r1", "media/b.png", False), ("r2", "http://x/a.png", True), ("r3", "gone.png", False), ("r4", "./media/../media/c.png", False), ("r5", "media/b.png", False), ("r6", "media/d.png", False), ("r6", "media/e.png", False))


def docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and content: every text as a DOCX file, made in the row. Every third line is a table, every fourth file has notes, every line refers to a picture by its length."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                lines = text.split("\n")
                cells = [line.split(", ") for line in lines]
                blocks = [[row, row[:1]] if n % 3 == 2 else line for n, (line, row) in enumerate(zip(lines, cells, strict=True))]
                notes = {"-1": "none", "2": lines[0]} if doc_id % 4 == 0 else None
                files.append(docx_parts.document(blocks, notes, [f"r{len(line) % 9}" for line in lines], list(LINKS)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "content": files})

    # What XML 1.0 cannot hold becomes a blank.
    text = F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.alias("text")).mapInPandas(made, "doc_id long, content binary")


#: Bytes of pictures that leave a worker at once; a larger picture leaves alone.
PICTURE_BYTES = 4 << 20


def pictures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, width and pixels of texts (doc_id, text): sixteen pixels a byte, so pictures are sent on as soon as they fill PICTURE_BYTES."""

    def sent(ids: list[int], made: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([320] * len(ids), pa.int32()), pa.array(made, pa.binary())], names=["doc_id", "width", "pixels"])

    ids, made, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            plain = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
            row = np.repeat(np.where(plain < doc_id.as_py() * 7 % 128, plain, 255).astype(np.uint8), 16)
            picture = np.append(row, np.full(-len(row) % 320, 255, dtype=np.uint8)).tobytes()
            if held and held + len(picture) > PICTURE_BYTES:
                yield sent(ids, made)
                ids, made, held = [], [], 0
            ids.append(doc_id.as_py())
            made.append(picture)
            held += len(picture)
    if ids:
        yield sent(ids, made)


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, width and pixels: the bytes of every text as greys, sixteen pixels each, those of a document's own bound and above white; the last row of pixels filled up with white."""
    return table(spark, sf_dir, "documents", "doc_id", "text").mapInArrow(pictures, "doc_id long, width int, pixels binary")
