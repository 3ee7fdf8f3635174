"""Columns that hold values: native ones where the kind is known, else a struct (tag, s, n, ts) ordered like values."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from asserta.model import Tag, TypeMismatch, Value

NATIVE = {Tag.STRING: "string", Tag.IDENT: "string", Tag.REF: "bigint", Tag.TIMESTAMP: "timestamp", Tag.BOOLEAN: "boolean", Tag.LONG: "bigint"}
ANY = "struct<tag:tinyint,s:string,n:bigint,ts:timestamp>"
#: Which flat column holds a kind's payload.
SLOT = {Tag.STRING: "s", Tag.IDENT: "s", Tag.REF: "n", Tag.TIMESTAMP: "ts", Tag.BOOLEAN: "n", Tag.LONG: "n"}


def native(kind: Tag) -> Column:
    """The payload of flat columns whose tag is `kind`."""
    return F.col("n") == 1 if kind == Tag.BOOLEAN else F.col(SLOT[kind])


def flat(kind: Tag, column: Column) -> list[Column]:
    """tag, s, n, ts of a native column."""
    slot = SLOT[kind]
    return [
        F.lit(int(kind)).cast("tinyint").alias("tag"),
        *((column.cast("bigint" if s == "n" else NATIVE[kind]) if s == slot else F.lit(None).cast(t)).alias(s) for s, t in (("s", "string"), ("n", "bigint"), ("ts", "timestamp"))),
    ]


def any_value() -> Column:
    return F.struct("tag", "s", "n", "ts")


def widened(column: Column, kind: Tag | None) -> Column:
    """A column of values of any kind."""
    return column if kind is None else F.struct(*flat(kind, column))


def narrowed(column: Column, kind: Tag) -> Column:
    """The payloads of kind `kind` of a column of any kind."""
    return column["n"] == 1 if kind == Tag.BOOLEAN else column[SLOT[kind]]


def literal(value: Value) -> Column:
    """A native literal."""
    x = value.payload
    if value.tag == Tag.TIMESTAMP and isinstance(x, dt.datetime) and x.tzinfo is None:
        x = x.replace(tzinfo=dt.timezone.utc)
    return F.lit(x).cast(NATIVE[value.tag])


def matches(value: Value) -> Column:
    """Flat columns that hold exactly this value; flat predicates reach the scan."""
    payload = F.col("n") == int(value.payload) if value.tag == Tag.BOOLEAN else F.col(SLOT[value.tag]) == literal(value)
    return (F.col("tag") == int(value.tag)) & payload


def compared(op: str, left: Column, left_kind: Tag | None, right: Column, right_kind: Tag | None) -> Column:
    """left op right in the order of all values: by kinds where they are known to differ, natively where they are
    known to be equal, else by structs."""
    if left_kind is not None and right_kind is not None and left_kind != right_kind:
        return F.lit({"<": left_kind < right_kind, ">": left_kind > right_kind, "not": True}[op])
    if left_kind is None or right_kind is None:
        left, right = widened(left, left_kind), widened(right, right_kind)
    if op == "<":
        return left < right
    if op == ">":
        return left > right
    if op == "not":
        return left != right
    raise TypeMismatch(f"{op} is no comparison")


def shown(column: Column, kind: Tag | None) -> Column:
    """Values as text: strings in quotes, all else plain."""
    if kind is None:
        text = F.when(column["tag"] == int(Tag.STRING), F.concat(F.lit('"'), column["s"], F.lit('"')))
        text = text.when(column["tag"] == int(Tag.IDENT), column["s"]).when(column["tag"] == int(Tag.TIMESTAMP), column["ts"].cast("string"))
        return text.when(column["tag"] == int(Tag.BOOLEAN), F.when(column["n"] == 1, "true").otherwise("false")).otherwise(column["n"].cast("string"))
    return F.concat(F.lit('"'), column, F.lit('"')) if kind == Tag.STRING else column.cast("string")
