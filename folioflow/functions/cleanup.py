"""Conservative clean-up of Markdown: page numbers out, hyphens and broken lines joined, as native expressions.

The reflow is a fold over a text's lines: whether a line continues the open paragraph depends on all
that was joined so far, so a window over neighbouring lines cannot express it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import newlines, strip

WORD = r"\p{L}\p{N}_"


def dehyphenate(text: Column) -> Column:
    """Words broken by a hyphen at a line end, whole again."""
    return F.regexp_replace(text, rf"(?<=[{WORD}])-\n(?=[{WORD}])", "")


def is_page_number(line: Column) -> Column:
    return line.rlike(r"(?iuU)\A(?:стр\.?|страница)\s*\d{1,3}(?:\s*из\s*\d{1,3})?\z")


def is_structural(line: Column) -> Column:
    """Headings, quotes, table rows, list items and rules."""
    return line.rlike(r"(?U)\A(?:[#>|]|[-*+]\s|\d+[.)]\s|-{3,}\z)")


def joins(open_text: Column, line: Column) -> Column:
    """Does a line continue the open paragraph?"""
    ended = open_text.rlike(r'[.!?:;»"]\z')
    new_sentence = line.rlike(r"\A\p{IsUppercase}") & (F.length(open_text) > 80)
    return ~(is_structural(open_text) | is_structural(line) | ended | new_sentence)


def _flushed(state: Column) -> Column:
    return F.when(state["open"] != "", F.array_append(state["out"], strip(state["open"]))).otherwise(state["out"])


def reflow(lines: Column) -> Column:
    """Lines (stripped) with paragraphs joined; at most one empty line in a row."""

    def step(state: Column, line: Column) -> Column:
        done = _flushed(state)
        blank_after = F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ""), F.array_append(done, F.lit(""))).otherwise(done)
        blank = F.struct(blank_after.alias("out"), F.lit("").alias("open"))
        structural = F.struct(F.array_append(done, line).alias("out"), F.lit("").alias("open"))
        longer = F.struct(state["out"].alias("out"), F.concat(state["open"], F.lit(" "), line).alias("open"))
        fresh = F.struct(done.alias("out"), line.alias("open"))
        goes_on = (state["open"] != "") & joins(state["open"], line)
        return F.when(line == "", blank).when(is_structural(line), structural).when(goes_on, longer).otherwise(fresh)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))
    return F.aggregate(lines, start, step, _flushed)


def clean_markdown(text: Column) -> Column:
    """The whole clean-up."""
    squeezed = F.regexp_replace(dehyphenate(strip(newlines(text))), r"[ \t]+", " ")
    lines = F.transform(F.split(squeezed, "\n", -1), strip)
    kept = F.filter(lines, lambda line: ~is_page_number(line))
    return strip(F.regexp_replace(F.array_join(reflow(kept), "\n"), r"\n{3,}", "\n\n"))
