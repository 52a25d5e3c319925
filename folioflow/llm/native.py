"""Column builders shared by the native operators, linear in the text and its matches.

Higher-order functions copy their state at every step, so no state here grows with the number of matches:
running sums are taken within blocks of about the square root of the matches, and then over the blocks.
``let`` binds a value, so that it is computed once although a body names it several times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<s:int,e:int,v:string>>"
#: Code points in a block of a text that pieces are cut from.
BLOCK_CHARS = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, larger: bool = False) -> Column:
    """Running sums (or maxima) of an array of integers."""
    join = (lambda a, b: F.greatest(a, b)) if larger else (lambda a, b: a + b)
    nothing = F.array().cast("array<int>")

    def scan(part: Column) -> Column:
        return F.aggregate(part, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, join(F.element_at(acc, -1), x).cast("int")), lambda acc: F.slice(acc, F.lit(2), F.greatest(F.size(acc) - 1, F.lit(0))))

    def blocks(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda i: scan(F.slice(v, i * width + 1, width)))

    def whole(parts: Column) -> Column:
        before = F.transform(parts, lambda p: F.element_at(p, -1))
        starts = let(scan(before), lambda sums: F.concat(F.array(F.lit(0)), sums))
        return let(starts, lambda at: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: join(x, at[i]).cast("int")))))

    return let(F.coalesce(values, nothing), lambda v: F.when(F.size(v) > 0, let(blocks(v), whole)).otherwise(nothing))


def spans(text: Column, pattern: Column) -> Column:
    """All leftmost non-overlapping matches of a pattern: array of (s, e, v), s and e in code points, e exclusive.

    The pattern must not match the empty string. What ``split`` leaves between the matches gives their places.
    """

    def placed(z: Column) -> Column:
        steps = F.zip_with(F.slice(z["b"], F.lit(1), F.size(z["f"])), z["f"], lambda b, f: F.length(b) + F.length(f))
        return F.zip_with(z["f"], running(steps), lambda f, e: F.struct((e - F.length(f)).cast("int").alias("s"), e.cast("int").alias("e"), f.alias("v")))

    return let(F.struct(F.split(text, pattern, -1).alias("b"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("f")), placed)


def counted(places: Column, marks: Column, inclusive: bool) -> Column:
    """For each of ``marks``, how many of ``places`` are smaller (or equal, if ``inclusive``). Both are arrays of integers."""
    word, mark = (0, 1) if inclusive else (1, 0)
    entry = lambda p, t, i: F.struct(p.cast("int").alias("p"), F.lit(t).alias("t"), i.cast("int").alias("i"))
    entries = F.array_sort(F.concat(F.transform(places, lambda p: entry(p, word, F.lit(-1))), F.transform(marks, lambda p, i: entry(p, mark, i))))

    def numbered(x: Column) -> Column:
        sums = running(F.transform(x, lambda y: F.when(y["i"] < 0, 1).otherwise(0)))
        found = F.filter(F.zip_with(x, sums, lambda y, n: F.struct(y["i"].alias("i"), n.alias("n"))), lambda y: y["i"] >= 0)
        return F.transform(F.array_sort(found), lambda y: y["n"])

    return let(entries, numbered)


def text_blocks(text: Column) -> Column:
    """A text in blocks of BLOCK_CHARS code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))


def piece(blocks: Column, start: Column, stop: Column) -> Column:
    """Code points start..stop of a text in blocks; nothing if stop <= start."""
    first = F.floor(start / BLOCK_CHARS).cast("int")
    last = F.floor((stop - 1) / BLOCK_CHARS).cast("int")
    held = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(stop > start, F.substr(held, (start - first * BLOCK_CHARS + 1).cast("int"), (stop - start).cast("int"))).otherwise(F.lit(""))
