"""Measured runs: totals out of the pass that writes, and their report."""

import json

from pyspark.sql import functions as F

from folioflow import settings as S
from folioflow.operators import conversion, reports
from folioflow.plans import measure


def results(spark, confidence):
    entry = (1, "ocr", 12, "Мало текста.", confidence, 6, 300, "gray", 9, "why")
    rows = [(1, S.SCAN, S.PAGEWISE, "Первый документ: alpha beta, gamma. " * 20, [entry], "", 2), (2, S.DOCX, S.DOCX_METHOD, "Second document with качество. " * 20, None, "", None)]
    schema = f"doc_id long, doc_type string, method string, raw_text string, page_report {conversion.NO_REPORT}, error string, page_count int"
    return conversion.with_status(spark.createDataFrame(rows, schema), S.Settings(), "engine", ["rus", "eng"])


def test_totals_come_out_of_the_write(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    plain = results(spark, 71.25)

    def counted(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch

    seen = measure.observed_write(plain.mapInPandas(counted, plain.schema), f"{tmp_path}/out")
    assert seen == reports.run_totals(plain).first().asDict() and seen["mean_confidence"] == 71.2
    assert calls.value == 2 and spark.read.parquet(f"{tmp_path}/out").count() == 2  # each document was computed once


def test_report_of_two_modes(spark, tmp_path):
    wanted = measure.Wanted(("alpha beta gamma", "second document"), ("качество", "нет такого"))
    rows = [measure.measure("local", mode, results(spark, sure), wanted, f"{tmp_path}/{mode}") for mode, sure in (("standard", None), ("max", 90.0))]
    assert [(r["phrase_found"], r["russian_found"], r["passed"], r["average_confidence"]) for r in rows] == [(2, 1, True, None), (2, 1, True, 90.0)]
    assert not measure.measure("local", "max", results(spark, None), wanted, f"{tmp_path}/none")["passed"]
    modes = measure.mode_table(spark, rows).withColumn("seconds", F.lit(1.5))
    lines = [r["line"] for r in measure.markdown_lines(modes).orderBy("line_no").collect()]
    assert lines[:5] == ["# Measured runs", "", "- Result: PASS", "- max not worse than standard: PASS", "- Russian recognition: FAIL"]
    assert lines[8] == f"| local | max | PASS | 2/2 | 1/2 | 1.50 | 1 | 1 | 90.0 | {rows[1]['extracted_chars']} |" and "| n/a |" in lines[9]
    told = [json.loads(r["json"]) for r in measure.json_lines(modes).collect()]
    assert told[0]["average_confidence"] is None and told[1]["documents"] == 2
