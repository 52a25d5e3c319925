"""Texts are measured and cleaned once: what a plan must not hold twice."""

from __future__ import annotations

import tracemalloc

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import reports
from folioflow.plans import catalog, inputs
from folioflow.sources import recognition

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counts_of_letters_make_no_list_of_matches(spark):
    text = F.col("text")
    row = spark.createDataFrame([("Ab ё, x1y Яя�",)], "text string")
    known = row.select(T.letters(text), T.cyrillic(text), T.words(text), T.singles(text), T.replacements(text), T.cyrillic_share(text), T.single_share(text))
    assert tuple(known.first()) == (7, 3, 2, 3, 1, 3 / 7, 3 / 5)
    assert "regexp_extract_all" not in plan(catalog.document_status(spark, SMALL))


def test_report_lines_read_what_is_told_and_make_no_text_again(spark):
    for lines in (reports.run_report_lines, reports.ocr_report_lines):
        assert "translate(" not in plan(lines(inputs.results(spark, SMALL), inputs.RUN))


def test_sections_clean_a_text_once(spark):
    assert plan(catalog.combined_markdown(spark, SMALL)).count(r"-\n(?=") + plan(catalog.combined_markdown(spark, SMALL)).count("-\n(?=") == 1


def test_picture_places_read_files_once(spark):
    # One pass makes the files of the query, one reads them.
    assert plan(catalog.docx_picture_places(spark, SMALL)).count("MapInPandas") == 2


def test_measures_of_a_text_hold_no_list_of_its_letters():
    tracemalloc.start()
    assert recognition.measured.__wrapped__("ж" * 300_000) == (75.0, 0.8, 35.0, 0.0, 0.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000


def test_words_of_tables_are_found_without_a_filter_that_makes_the_tables_again(spark):
    assert plan(catalog.tsv_lines(spark, SMALL)).count("level\tblock_num") == 1
