"""Measured runs: what a conversion gave in each quality mode, gathered while its results are written.

The totals are observed in the pass that writes, so results are computed once; recall of phrases is taken over what was
written. A row per mode becomes a Markdown report and JSON.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import phrases, reports

MODES = "label string, mode string, seconds double, phrase_total long, phrase_found long, russian_total long, russian_found long, passed boolean, russian_passed boolean, documents long, failed long, ocr_pages long, review_pages long, average_confidence double, extracted_chars long"
HEADINGS = ("Run", "Mode", "Result", "Phrases", "Russian phrases", "Seconds", "OCR pages", "Review pages", "Mean confidence", "Characters")


@dataclass(frozen=True)
class Wanted:
    """Phrases that the texts of a run must hold, and those counted apart."""

    phrases: tuple[str, ...]
    russian: tuple[str, ...] = ()


def observed_write(results: DataFrame, path: str) -> dict:
    """Write ``results`` as Parquet, and give its totals (as ``reports.run_totals``) out of the same pass."""
    seen = Observation()
    results.observe(seen, *reports.total_columns()).write.mode("overwrite").parquet(path)
    return seen.get


def found_phrases(texts: DataFrame, wanted: tuple[str, ...]) -> int:
    """How many of the phrases stand in any of ``texts`` (text)."""
    if not wanted:
        return 0
    missing = phrases.phrase_recall(texts, list(wanted)).select(F.array_except(F.array(*[F.lit(p) for p in wanted]), "missing").alias("found"))
    return missing.select(F.explode("found")).distinct().count()


def measure(label: str, mode: str, results: DataFrame, wanted: Wanted, path: str) -> dict:
    """The row (MODES) of one run. It passes if no document failed and no phrase is missing; in the best mode a mean confidence is needed too."""
    began = time.monotonic()
    totals = observed_write(results, path)
    seconds = time.monotonic() - began
    texts = results.sparkSession.read.parquet(path).select(F.col("clean_markdown").alias("text"))
    found, russian = found_phrases(texts, wanted.phrases), found_phrases(texts, wanted.russian)
    passed = not totals["failed"] and found == len(wanted.phrases) and (mode != "max" or totals["mean_confidence"] is not None)
    return {
        "label": label, "mode": mode, "seconds": round(seconds, 2), "phrase_total": len(wanted.phrases), "phrase_found": found, "russian_total": len(wanted.russian), "russian_found": russian,
        "passed": passed, "russian_passed": russian == len(wanted.russian), "documents": totals["documents"], "failed": totals["failed"], "ocr_pages": totals["ocr_pages"],
        "review_pages": totals["page_warnings"], "average_confidence": totals["mean_confidence"], "extracted_chars": totals["chars"],
    }


def mode_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The rows of measured modes (MODES)."""
    names = [c.split()[0] for c in MODES.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], MODES)


def json_lines(modes: DataFrame) -> DataFrame:
    """A JSON object per mode."""
    return modes.select(F.to_json(F.struct(*modes.columns), {"ignoreNullFields": "false"}).alias("json"))


def markdown_lines(modes: DataFrame) -> DataFrame:
    """line_no and line of the Markdown report: the verdicts, then a table with a row per mode, in the order of label and mode."""
    told = phrases.verdict(modes)
    result = lambda c: F.when(F.col(c), F.lit("PASS")).otherwise(F.lit("FAIL"))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("n/a"))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = F.array(
        F.lit("# Measured runs"), F.lit(""), F.concat(F.lit("- Result: "), result("passed")), F.concat(F.lit("- max not worse than standard: "), result("max_not_worse")),
        F.concat(F.lit("- Russian recognition: "), result("russian_passed")), F.lit(""), row(*[F.lit(h) for h in HEADINGS]), row(*[F.lit("---")] * len(HEADINGS)),
    )
    cells = [
        F.col("label"), F.col("mode"), result("passed"), F.format_string("%d/%d", "phrase_found", "phrase_total"), F.format_string("%d/%d", "russian_found", "russian_total"),
        F.format_string("%.2f", "seconds"), shown("ocr_pages"), shown("review_pages"), T.optional_float(F.col("average_confidence"), "n/a"), shown("extracted_chars"),
    ]
    lines = modes.select("label", "mode", F.array(row(*cells)).alias("lines")).groupBy().agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("label", "mode", "lines"))), lambda x: x["lines"])).alias("rows"))
    every = told.crossJoin(lines).select(F.posexplode(F.concat(head, "rows")).alias("at", "line"))
    return every.select((F.col("at") + 1).cast("long").alias("line_no"), "line")
