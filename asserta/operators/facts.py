"""Views over recorded facts: what is true now or was true then, and the record itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asserta.model import FACT


def as_of(datoms: DataFrame, tx: int) -> DataFrame:
    """What had been recorded when transaction `tx` was done."""
    return datoms.where(F.col("tx") <= tx)


def current(datoms: DataFrame) -> DataFrame:
    """The set of facts whose last operation (by tx, retractions after additions) added them. Filters on the fact's
    columns pass below the aggregate; the packed long keeps it a hash aggregate with partial sums before the shuffle."""
    last = F.max(F.shiftleft("tx", 1) + F.col("retracted").cast("bigint"))
    return datoms.groupBy(*FACT).agg(last.alias("last")).where(F.col("last") % 2 == 0).select(*FACT)


def coalesced(datoms: DataFrame, order: tuple[str, ...] = FACT) -> DataFrame:
    """The record without operations that repeat the one before on the same fact, and of each whether it is what made
    the fact true now (current). order: the fact's columns; rows dealt out by ranges of these and sorted by them, tx and
    retracted are neither moved nor sorted again."""
    own = Window.partitionBy(*order).orderBy("tx", "retracted")
    undone = F.max(F.when(F.col("retracted"), F.col("tx"))).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = datoms.withColumns({"before": F.lag("retracted").over(own), "undone": undone})
    changes = marked.where(F.col("before").isNull() | (F.col("before") != F.col("retracted")))
    return changes.withColumn("current", ~F.col("retracted") & F.coalesce(F.col("tx") > F.col("undone"), F.lit(True))).drop("before", "undone")
