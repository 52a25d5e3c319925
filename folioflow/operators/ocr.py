"""Recognition attempts: the matrix of settings, word tables, scores and the choice of the best attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow import settings as S
from folioflow.functions import text as T


def attempt_matrix(pages: DataFrame, settings: S.Settings, dpi: tuple[int, ...] | None = None) -> DataFrame:
    """``pages`` times resolution x variant x segmentation mode, numbered from 1 in that nesting order."""
    cells = [(d, v, p) for d in (dpi or settings.dpi) for v in settings.variants for p in settings.psm]
    kind = "array<struct<attempt_no:int,dpi:int,variant:string,psm:int>>"
    matrix = F.array(*[F.struct(F.lit(n), F.lit(d), F.lit(v), F.lit(p)) for n, (d, v, p) in enumerate(cells, 1)]).cast(kind)
    return pages.select("*", F.inline(matrix))


def confidence(value: Column) -> Column:
    """A confidence from text; null if it is no number, not a number, or negative."""
    number = F.trim(value).try_cast("double")
    return F.when((number >= 0) & ~F.isnan(number), number)


def word_table(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of words from tab-separated word tables (column ``tsv``): keys, pos, block_num, par_num, line_num, conf, text.

    Columns are found by the header. Tables without the five columns, short rows and blank words give none.
    """
    lines = F.filter(F.split(T.newlines(F.col("tsv")), "\n", -1), lambda x: T.strip(x) != "")
    names = ("block_num", "par_num", "line_num", "conf", "text")
    # Words are found within their row and no filter stands behind: it would be handed down and make the tables twice.
    listed = tables.select(*keys, T.let(lines, lambda x: x).alias("lines"))
    split = listed.select(*keys, F.split(F.try_element_at("lines", F.lit(1)), "\t", -1).alias("head"), F.slice("lines", F.lit(2), F.greatest(F.size("lines"), F.lit(1))).alias("body"))
    placed = split.select(*keys, "body", *[F.array_position("head", F.lit(n)).cast("int").alias(f"at_{n}") for n in names])
    whole = F.least(*[F.col(f"at_{n}") for n in names]) > 0

    def word(row: Column, pos: Column) -> Column:
        cell = lambda cells, n: F.try_element_at(cells, F.col(f"at_{n}"))
        told = lambda cells: F.struct(pos.alias("pos"), *[cell(cells, n).alias(n) for n in names[:-1]], T.strip(cell(cells, "text")).alias("text"))
        return T.let(F.split(row, "\t", -1), lambda cells: F.when(F.size(cells) >= F.col("at_text"), told(cells)))

    words = F.filter(F.transform("body", word), lambda w: w["text"] != "")
    return placed.select(*keys, F.inline(F.when(whole, words)))


def recognised_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first_pos and line of every line of words, in the order in which lines are first met."""
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return words.groupBy(*keys, "block_num", "par_num", "line_num").agg(F.min("pos").alias("first_pos"), line.alias("line"))


def recognised_text(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text and confidence (mean of the words', one decimal; null if none has any)."""
    lines = recognised_lines(words, keys)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_pos", "line"))), lambda x: x["line"]), "\n")
    texts = lines.groupBy(*keys).agg(text.alias("text"))
    sure = words.groupBy(*keys).agg(F.bround(F.avg(confidence(F.col("conf"))), 1).alias("confidence"))
    return texts.join(sure, keys)


def measures(text: Column) -> dict[str, Column]:
    """What a score needs to know of a recognised text (normalised), whatever the attempt."""
    return {"chars": F.length(text), "words": T.words(text), "cyrillic": T.cyrillic_share(text), "replacements": T.replacements(text), "singles": T.single_share(text)}


def measured_score(of: dict[str, Column], sure: Column) -> Column:
    """How good a recognised text of these measures looks, unrounded."""
    value = (
        F.least(of["chars"], F.lit(2500)) * 0.03
        + of["words"] * 0.8
        + F.coalesce(sure, F.lit(0.0)) * 2.0
        + of["cyrillic"] * 35.0
        - of["replacements"] * 8.0
        - of["singles"] * 40.0
    )
    return F.when(of["chars"] == 0, 0.0).otherwise(value)


def psm_bonus(psm: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in S.PSM_BONUS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, psm), F.lit(0.0))


def final_score(of: dict[str, Column], sure: Column, psm: Column) -> Column:
    """The score of an attempt of these measures, rounded as it is compared."""
    return F.bround(F.bround(measured_score(of, sure), 3) + psm_bonus(psm), 3)


def scored(attempts: DataFrame) -> DataFrame:
    """``attempts`` (text, confidence, psm) with the text normalised and ``score``."""
    plain = attempts.withColumn("text", T.strip(T.newlines(F.col("text"))))
    return plain.withColumn("score", final_score(measures(F.col("text")), F.col("confidence"), F.col("psm")))


def best_attempts(attempts: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The row of the best attempt of every page, with ``attempt_count``, the attempts that were needed.

    The best so far is that of the highest score, the earliest among equals. From attempt ``least`` on, the
    search stops as soon as the best so far is confident and long enough. One sort by page serves both
    windows; nothing is joined. Rows with ``chars``, the length of their text, need not carry the text.
    """
    chars = F.col("chars") if "chars" in attempts.columns else F.length("text")
    page = Window.partitionBy(*keys)
    so_far = page.orderBy("attempt_no").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.struct("score", (-F.col("attempt_no")).alias("order"), "confidence", chars.alias("chars"))
    running = attempts.withColumn("__best", F.max(rank).over(so_far))
    good = (F.col("attempt_no") >= least) & (F.col("__best.confidence") >= S.STOP_CONFIDENCE) & (F.col("__best.chars") >= S.LOW_TEXT)
    ended = running.withColumn("__stop", F.coalesce(F.min(F.when(good, F.col("attempt_no"))).over(page), F.max("attempt_no").over(page)))
    chosen = F.max(F.when(F.col("attempt_no") == F.col("__stop"), -F.col("__best.order"))).over(page)
    return ended.withColumn("__chosen", chosen).filter(F.col("attempt_no") == F.col("__chosen")).withColumn("attempt_count", F.col("__stop")).drop("__best", "__stop", "__chosen")


def reason(score: Column, sure: Column, dpi: Column, psm: Column, variant: Column, attempts: Column) -> Column:
    """Why an attempt was chosen, as text."""
    return F.concat(
        F.format_string("score=%.1f", score), F.lit("; confidence="), T.optional_float(sure, "нет"), F.lit("; dpi="), dpi.cast("string"),
        F.lit("; psm="), psm.cast("string"), F.lit("; variant="), variant, F.lit("; attempts="), attempts.cast("string"),
    )
