"""From the paragraphs of DOCX files to blocks and texts, and from references to the pictures that a file shows.

``sources.docx_parts`` gives a row per paragraph with its place. A cell is its paragraphs, a row its cells, a table its rows
filled up to the widest, a note its blocks: groupings of one another, all within a document, so that rows are dealt once, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.sources import docx_parts

TITLES = ("", "Сноски", "Концевые сноски")
NO_TEXT = "Встроенное чтение DOCX не извлекло текст."
PICTURES_HEAD = "## Текст из изображений DOCX"
PLACE = ["doc_id", "part", "note_no", "note", "block", "kind"]


def _gathered(order: str, value: str) -> Column:
    """The values of a group by their order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])


def table_text(rows: Column) -> Column:
    """A Markdown table of rows of cells, short rows filled up with empty cells."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    lines = F.transform(rows, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    rule = F.array(line(F.array_repeat(F.lit("---"), width)))
    return F.array_join(F.concat(F.slice(lines, F.lit(1), F.lit(1)), rule, F.slice(lines, F.lit(2), F.size(lines))), "\n")


def blocks_of(paragraphs: DataFrame) -> DataFrame:
    """Blocks (doc_id, part, note_no, block, kind, text, error) of paragraphs (doc_id and ``docx_parts.PLACED``): paragraphs, tables and notes.

    A table's rows without text are left out. Every file keeps one row without a part, with its ``error`` if it could not be read. One chain
    of groupings, so that files are read once.
    """
    plain = paragraphs.repartition("doc_id").withColumn("text", T.docx_text(F.col("text")))
    sign = F.col("part").isNull()
    full = F.filter(_gathered("n", "text"), lambda x: x != "")
    cells = plain.groupBy(*PLACE, "error", "row", "cell").agg(F.array_join(full, " ").alias("text"))
    cells = cells.withColumn("text", F.when(F.col("kind") == "table", T.table_cell(F.col("text"))).otherwise(F.col("text")))
    rows = cells.groupBy(*PLACE, "error", "row").agg(_gathered("cell", "text").alias("cells")).filter(sign | F.exists("cells", lambda c: c != ""))
    whole = rows.groupBy(*PLACE, "error").agg(_gathered("row", "cells").alias("rows"))
    text = F.when(F.col("kind") == "table", table_text(F.col("rows"))).otherwise(F.col("rows")[0][0])
    # The blocks of a note are one; those of the body stay apart.
    noted = F.col("part") > 0
    own, kind = F.when(noted, 0).otherwise(F.col("block")), F.when(noted, "note").otherwise(F.col("kind"))
    placed = whole.select("doc_id", "part", "note_no", "note", "error", own.alias("own"), kind.alias("kind"), "block", text.alias("text"))
    joined = placed.groupBy("doc_id", "part", "note_no", "note", "error", "own", "kind").agg(F.array_join(_gathered("block", "text"), "\n\n").alias("text"))
    told = F.when(noted, F.concat(F.lit("["), "note", F.lit("] "), "text")).otherwise(F.col("text"))
    return joined.select("doc_id", "part", "note_no", F.col("own").alias("block"), "kind", told.alias("text"), "error")


def docx_blocks(files: DataFrame) -> DataFrame:
    """Blocks of ``files`` (doc_id, content), and a row without a part for every file."""
    return blocks_of(docx_parts.paragraphs(files))


def docx_text(blocks: DataFrame) -> DataFrame:
    """doc_id, raw_text and error of every file: its ``blocks`` in order with an empty line between, notes under the heading of their part."""
    order = F.struct("part", "note_no", "block", "text")
    rows = F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), order)))
    title = lambda part: F.element_at(F.array(*[F.lit(f"## {t}\n\n") for t in TITLES]), part + 1)
    whole = blocks.groupBy("doc_id").agg(rows.alias("rows"), F.max("error").alias("error"))
    first = lambda x, i: (x["part"] > 0) & ((i == 0) | (F.coalesce(F.get(F.col("rows"), i - 1)["part"], F.lit(-1)) != x["part"]))
    text = F.array_join(F.transform("rows", lambda x, i: F.when(first(x, i), F.concat(title(x["part"]), x["text"])).otherwise(x["text"])), "\n\n")
    return whole.select("doc_id", text.alias("raw_text"), F.when((F.col("error") == "") & (F.size("rows") == 0), NO_TEXT).otherwise(F.col("error")).alias("error"))


def picture_places(references: DataFrame) -> DataFrame:
    """doc_id, number and target of the pictures that documents show, by first reference, of ``docx_parts.references``.

    References meet relationships within their part; of relationships of one id the last counts. A target that is not in
    the file is none, one that is referred to again counts where it stood first.
    """
    # No branch filters the rows for itself: filters would be handed down below the shuffle, and every branch would read the files again.
    asks = F.col("part").isNotNull() & F.col("target").isNull()
    gives = F.col("part").isNotNull() & F.col("target").isNotNull()
    place = F.struct("part_no", "position")
    by_link = references.groupBy("doc_id", "part", "link").agg(F.min(F.when(asks, place)).alias("first"), F.max(F.when(gives, F.struct("position", "target")))["target"].alias("given"), F.collect_set(F.when(F.col("part").isNull(), F.col("target"))).alias("names"))
    shown = F.when(F.col("first").isNotNull() & F.col("given").isNotNull(), F.struct(F.col("given").alias("target"), "first"))
    whole = by_link.groupBy("doc_id").agg(F.collect_list(shown).alias("shown"), F.flatten(F.collect_list("names")).alias("names"))
    met = whole.select("doc_id", F.inline(F.filter("shown", lambda x: F.array_contains("names", x["target"]))))
    first = met.groupBy("doc_id", "target").agg(F.min("first").alias("first"))
    return first.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).alias("number"), "target")


def docx_pictures(files: DataFrame) -> DataFrame:
    """doc_id, number, target and content of the embedded pictures of ``files`` (doc_id, content)."""
    places = picture_places(docx_parts.references(files)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "target"))).alias("targets"))
    return docx_parts.members(files.join(places, "doc_id"))


def with_pictures(texts: DataFrame, pictures: DataFrame) -> DataFrame:
    """``texts`` (doc_id, raw_text, error, ...) with the text of ``pictures`` (doc_id, blocks, page_report) at the end; a file that could not be read stays one."""
    joined = texts.join(pictures, "doc_id", "left")
    found = F.col("blocks").isNotNull() & F.col("error").isin("", NO_TEXT)
    whole = F.concat_ws("\n\n", F.nullif(F.col("raw_text"), F.lit("")), F.lit(PICTURES_HEAD), F.array_join("blocks", "\n\n"))
    report = F.when(found, F.col("page_report"))
    return joined.withColumn("page_report", report).withColumn("raw_text", F.when(found, whole).otherwise(F.col("raw_text"))).withColumn("error", F.when(found, "").otherwise(F.col("error"))).drop("blocks")


def picture_sections(recognised: DataFrame, least_letters: int = 20) -> DataFrame:
    """doc_id, page_index, block and text of recognised pictures (doc_id, number, text) with enough letters, numbered anew without gaps."""
    plain = recognised.withColumn("text", T.strip(T.newlines(F.col("text"))))
    kept = plain.filter(T.letters(F.col("text")) >= least_letters)
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("number"))
    return kept.withColumn("page_index", index).withColumn("block", F.concat(F.lit("### Изображение "), F.col("page_index").cast("string"), F.lit("\n\n"), F.col("text")))
