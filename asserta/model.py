"""Values, facts, queries and transactions as plain data, and how values lie in columns."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import types as T


class FactError(Exception):
    """What the engine raises on purpose."""


class ParseError(FactError):
    pass


class UnknownAttribute(FactError):
    pass


class TypeMismatch(FactError):
    pass


class UnboundVariable(FactError):
    pass


class Tag(IntEnum):
    """The kinds of values, in their order: any value of a kind is less than any of a later one."""

    STRING = 0
    IDENT = 1
    REF = 2
    TIMESTAMP = 3
    BOOLEAN = 4
    LONG = 5


@dataclass(frozen=True, order=True)
class Value:
    """A tagged value. Values of different kinds are never equal; order is by kind, then payload."""

    tag: Tag
    payload: str | int | bool | dt.datetime

    def __str__(self) -> str:
        return f'"{self.payload}"' if self.tag == Tag.STRING else str(self.payload)


def string(x: str) -> Value:
    return Value(Tag.STRING, x)


def ident(x: str) -> Value:
    return Value(Tag.IDENT, x)


def ref(x: int) -> Value:
    return Value(Tag.REF, x)


def timestamp(x: dt.datetime) -> Value:
    return Value(Tag.TIMESTAMP, x)


def boolean(x: bool) -> Value:
    return Value(Tag.BOOLEAN, x)


def long(x: int) -> Value:
    return Value(Tag.LONG, x)


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Clause:
    """A pattern over facts. The entity is a variable or an id, the attribute a variable or a name."""

    entity: Var | int
    attribute: Var | str
    value: Var | Value

    def variables(self) -> list[Var]:
        return [t for t in (self.entity, self.attribute, self.value) if isinstance(t, Var)]


@dataclass(frozen=True)
class Constraint:
    """left op right, where op is one of < > not."""

    op: str
    left: Var | Value
    right: Var | Value

    def variables(self) -> list[Var]:
        return [t for t in (self.left, self.right) if isinstance(t, Var)]


@dataclass(frozen=True)
class Query:
    find: tuple[Var, ...]
    clauses: tuple[Clause, ...]
    constraints: tuple[Constraint, ...] = ()


@dataclass(frozen=True)
class Fact:
    entity: int
    attribute: str
    value: Value


@dataclass(frozen=True)
class Add:
    fact: Fact


@dataclass(frozen=True)
class Retract:
    fact: Fact


@dataclass(frozen=True)
class NewEntity:
    """Attributes of an entity whose id the transactor gives; of an attribute said twice the last counts."""

    attributes: tuple[tuple[str, Value], ...]


@dataclass(frozen=True)
class Tx:
    items: tuple[Add | Retract | NewEntity, ...]


@dataclass(frozen=True)
class Command:
    """`test` loads the sample, `dump` shows all facts."""

    name: str


@dataclass(frozen=True)
class TxReport:
    """tx and new entities of a transaction that succeeded, or the error of one that changed nothing."""

    tx: int | None = None
    new_entities: tuple[int, ...] = ()
    error: FactError | None = None

    @property
    def ok(self) -> bool:
        return self.error is None


#: A recorded fact. One of s (string, ident), n (ref, boolean as 0 and 1, long) and ts (timestamp) is set, by tag.
#: The payloads lie in flat columns, since predicates on a struct don't reach the Parquet scan.
DATOM = T.StructType(
    [
        T.StructField("e", T.LongType(), False),
        T.StructField("a", T.LongType(), False),
        T.StructField("tag", T.ByteType(), False),
        T.StructField("s", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("tx", T.LongType(), False),
        T.StructField("retracted", T.BooleanType(), False),
    ]
)
FACT = ("e", "a", "tag", "s", "n", "ts")


def datom(e: int, a: int, value: Value, tx: int, retracted: bool = False) -> tuple:
    """The row of DATOM."""
    text = value.payload if value.tag in (Tag.STRING, Tag.IDENT) else None
    number = int(value.payload) if value.tag in (Tag.REF, Tag.BOOLEAN, Tag.LONG) else None
    at = value.payload if value.tag == Tag.TIMESTAMP else None
    return (e, a, int(value.tag), text, number, at, tx, retracted)
