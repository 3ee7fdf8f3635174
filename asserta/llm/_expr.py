"""Helpers for Spark expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256  # elements that `running` joins at a time
PIECE = 4096  # code points of a piece


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(counts: Column, join: Callable[[Column, Column], Column] = add) -> Column:
    """All earlier elements and the own one joined (summed), from 0 on, in blocks so that copying stays near linear."""

    def block(start: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(start.alias("at"), F.array().cast("array<long>").alias("all")), lambda acc, n: let(join(acc["at"], n), lambda m: F.struct(m.alias("at"), F.concat(acc["all"], F.array(m)).alias("all"))))

    whole = F.array_compact(F.transform(F.sequence(F.lit(0), F.size(counts) - 1, F.lit(BLOCK)), lambda i: F.slice(counts, i + 1, F.lit(BLOCK))))
    summed = F.aggregate(
        whole,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<long>>").alias("all")),
        lambda acc, part: let(block(acc["at"], part), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["all"], F.array(x["all"])).alias("all"))),
    )["all"]
    return F.flatten(summed)


def pieces(text: Column) -> Column:
    """A text as pieces of PIECE code points, from which `stretch` cuts."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def stretch(parts: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text in pieces: looks at its own pieces only, not at all before it."""
    i, j = (F.floor(x / PIECE).cast("int") for x in (start, end))
    first, last = (F.coalesce(F.get(parts, k), F.lit("")) for k in (i, j))
    at, to = ((x % PIECE).cast("int") for x in (start, end))
    over = F.concat(F.substring(first, at + 1, F.lit(PIECE)), F.array_join(F.slice(parts, i + 2, j - i - 1), ""), F.substring(last, F.lit(1), to))
    return F.when(i == j, F.substring(first, at + 1, to - at)).otherwise(over)
