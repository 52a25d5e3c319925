"""The list of documents to convert, and the names of what is written for them.

Spark's file sources drop names that begin with a dot or an underscore and match suffixes by case, so
folders are listed on the driver; the list has a row per file, and file contents are read by executors.
"""

from __future__ import annotations

import datetime as dt
import os
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import settings as S

LISTED = "doc_id long, path string, name string, ext string, rel_parts array<string>, stem string"
#: Listings up to this size are named on the driver, where they were made; larger ones by families. The names are the same.
NAMED_AT_ONCE = 10_000


def skipped(parts: Column) -> Column:
    """Is a file to be left out because of a folder that it lies in? ``parts``: the folders' names, the file's not among them."""
    bad_start = lambda p: F.lit(False) | p.startswith(S.SKIPPED_PREFIXES[0]) | p.startswith(S.SKIPPED_PREFIXES[1]) | p.startswith(S.SKIPPED_PREFIXES[2])
    return F.exists(parts, lambda p: p.isin(*S.SKIPPED_DIRS) | bad_start(p))


def wanted(name: Column, parts: Column) -> Column:
    """Is a file a document to convert?"""
    known = F.regexp_extract(F.lower(name), r"(\.[^.]+)\z", 1).isin(*S.EXTENSIONS)
    return known & ~name.startswith("~$") & ~skipped(parts)


def output_stem(parts: Column, stem: Column) -> Column:
    """The output name before it is made unique."""
    from folioflow.functions.text import file_safe

    safe = file_safe(F.array_join(F.concat(parts, F.array(stem)), "__"))
    return F.when(safe == "", F.lit("document")).otherwise(safe)


def unique_names(stems: Iterable[str], suffix: str = ".md") -> list[str]:
    """File names that differ in more than case; the order of the stems decides who gets the plain one."""
    taken: set[str] = set()
    out = []
    for stem in stems:
        number, name = 1, f"{stem}{suffix}"
        while name.lower() in taken:
            number += 1
            name = f"{stem}_{number}{suffix}"
        taken.add(name.lower())
        out.append(name)
    return out


def families(stems: DataFrame) -> DataFrame:
    """low and root of the lower-cased ``stems`` (low, rows) whose names depend on one another: several rows have them, or they could be the numbered name of such a one.

    ``a_2`` may meet the second ``a``, and then its own second name ``a_2_2``; so families are chains over the part before a number. They are
    found by joins, one for each number that stems of a family end in; a stem that can meet none is in no family.
    """
    before = F.regexp_extract("low", r"(?s)\A(.*)_([2-9]|[1-9][0-9]+)\z", 1)
    known = stems.select("low", "rows", F.when(before != "", before).alias("parent")).persist()
    active = fringe = known.filter("rows > 1").select("low", "parent").persist()
    while not fringe.isEmpty():
        reached = known.join(fringe.select(F.col("low").alias("parent")), "parent", "left_semi").select("low", "parent")
        fringe = reached.join(active.select("low"), "low", "left_anti").persist()
        active = active.unionByName(fringe).persist()
    roots = active.select("low", F.col("low").alias("root"), F.col("parent").alias("up")).persist()
    there = active.select(F.col("low").alias("up"), F.col("parent").alias("next"), F.lit(True).alias("there"))
    while True:
        raised = roots.join(there, "up", "left")
        if raised.filter("there").isEmpty():
            return roots.select("low", "root")
        roots = raised.select("low", F.when(F.col("there"), F.col("up")).otherwise(F.col("root")).alias("root"), F.when(F.col("there"), F.col("next")).alias("up")).persist()


def with_unique_names(files: DataFrame, suffix: str = ".md") -> DataFrame:
    """``files`` (doc_id, stem, ...) with output_name: names that differ in more than case; the order of doc_id decides who gets the plain one.

    Only stems that can meet others are grouped, a family at a time, and named by the sequential rule; all others keep their own.
    """
    low = F.lower("stem")
    roots = families(files.groupBy(low.alias("low")).agg(F.count("*").alias("rows")))

    def named(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        return pd.DataFrame({"doc_id": rows["doc_id"], "__name": unique_names(rows["stem"], suffix)})

    grouped = files.select("doc_id", "stem", low.alias("low")).join(roots, "low").groupBy("root").applyInPandas(named, "doc_id long, __name string")
    return files.join(grouped, "doc_id", "left").withColumn("output_name", F.coalesce("__name", F.concat("stem", F.lit(suffix)))).drop("__name")


def list_files(folder: str, results: str | None = None) -> list[tuple[str, str, str, list[str]]]:
    """(path, name, extension, folders) of the documents below a folder, by lower-cased path."""
    found = []
    for top, folders, names in os.walk(folder):
        below = Path(top).relative_to(folder).parts
        inside = results and Path(results) in (Path(top), *Path(top).parents)
        if inside or any(p in S.SKIPPED_DIRS or p.startswith(S.SKIPPED_PREFIXES) for p in below):
            folders.clear()
            continue
        for name in names:
            ext = Path(name).suffix
            if ext.lower() in S.EXTENSIONS and not name.startswith("~$"):
                found.append((str(Path(top) / name), name, ext, list(below)))
    return sorted(found, key=lambda x: (x[0].lower(), x[0]))


def manifest(spark: SparkSession, folder: str, results: str | None = None) -> DataFrame:
    """The documents of a folder; doc_id counts from 0 in listing order."""
    rows = [(n, *file, Path(file[1]).stem) for n, file in enumerate(list_files(folder, results))]
    if len(rows) > NAMED_AT_ONCE:
        files = spark.createDataFrame(rows, LISTED).withColumn("stem", output_stem(F.col("rel_parts"), F.col("stem")))
        return with_unique_names(files).drop("stem")
    safe = [re.sub(r'[<>:"/\\|?*\x00-\x1F]', "_", "__".join([*below, stem])).strip(" .") or "document" for *_, below, stem in rows]
    return spark.createDataFrame([(*row[:-1], name) for row, name in zip(rows, unique_names(safe), strict=True)], LISTED.replace("stem string", "output_name string"))


def contents(files: DataFrame) -> DataFrame:
    """``files`` (doc_id, path) with ``content``, read by the executors from a folder that all of them see."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, path in zip(batch["doc_id"], batch["path"], strict=True):
                yield pd.DataFrame({"doc_id": [doc_id], "path": [path], "content": [Path(path).read_bytes()]})

    return files.select("doc_id", "path").mapInPandas(read, "doc_id long, path string, content binary")


def result_folder(folder: str, now: dt.datetime, prefix: str = "markdown_result") -> Path:
    """A new folder named after the minute; later ones of the same minute get _2, _3 and so on."""
    base = Path(folder) / f"{prefix}_{now:%Y-%m-%d_%H-%M}"
    path, number = base, 1
    while path.exists():
        number += 1
        path = base.with_name(f"{base.name}_{number}")
    path.mkdir(parents=True)
    return path


def latest_result(folder: str) -> Path | None:
    """The result folder that was changed last."""
    return max((p for p in Path(folder).glob("markdown_result_*") if p.is_dir()), key=lambda p: p.stat().st_mtime, default=None)
