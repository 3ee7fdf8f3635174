"""Relational tables seen as facts: a row is an entity, a column an attribute, a null no fact.

An entity is the table's number above bit 40 and the row's key below. Patterns with a given attribute become scans of
the table's own columns, one for all patterns of an entity; only patterns with a free attribute unfold rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asserta.functions.values import ANY, NATIVE, flat, literal
from asserta.model import DATOM, FACT, Tag, Value, Var, datom, ident
from asserta.operators.relational import Relation
from asserta.plans.binder import Pattern
from asserta.schema import FIRST_ID, IDENT, TYPE_NAMES, VALUE_TYPE, Schema, bootstrap

SHIFT = 40


@dataclass(frozen=True)
class Attribute:
    name: str
    column: str
    kind: Tag
    table: int | None = None  # of the entities it refers to


@dataclass(frozen=True)
class Table:
    name: str
    number: int
    key: str | None  # None: rows are told by a hash of their contents
    attributes: tuple[Attribute, ...]


def entity(number: int, key: int) -> int:
    return number << SHIFT | key


class Mapped:
    """A source over tables that `read` gives by name."""

    def __init__(self, spark: SparkSession, tables: tuple[Table, ...], read: Callable[[str], DataFrame]):
        self.spark, self.read = spark, read
        self.tables = {t.number: t for t in tables}
        self.schema = Schema.start()
        self.owner: dict[int, tuple[Table, Attribute]] = {}
        names = {t: n for n, t in TYPE_NAMES.items()}
        self.definitions = bootstrap(dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc))
        for t in tables:
            for x in t.attributes:
                a = FIRST_ID + len(self.owner) + 1
                self.owner[a] = (t, x)
                for row in (datom(a, IDENT, ident(x.name), FIRST_ID), datom(a, VALUE_TYPE, ident(names[x.kind]), FIRST_ID)):
                    self.definitions.append(row)
                    self.schema.apply(a, row[1], ident(row[3]), False)

    def frame(self, t: Table) -> DataFrame:
        """A table's rows. Those of one without a key are told by their contents, so a row is the same entity in each
        scan; n different rows share one with a probability of about n² / 2^41."""
        df = self.read(t.name)
        return df if t.key else df.withColumn("row__", F.pmod(F.xxhash64(*[F.col(x.column) for x in t.attributes]), F.lit(1 << SHIFT)))

    def _entity(self, t: Table) -> Column:
        return F.col(t.key or "row__").cast("bigint") + F.lit(t.number << SHIFT).cast("bigint")

    def _value(self, x: Attribute) -> Column:
        column = F.col(x.column).cast(NATIVE[x.kind])
        return column + F.lit(x.table << SHIFT).cast("bigint") if x.table else column

    def _is(self, x: Attribute, value: Value) -> Column:
        """The column against a constant in the column's own terms, so that the scan can use it."""
        if value.tag != x.kind:
            return F.lit(False)
        if x.table:
            key = value.payload - (x.table << SHIFT)
            return F.col(x.column) == key if 0 <= key < 1 << SHIFT else F.lit(False)
        return F.col(x.column) == (F.lit(value.payload) if x.kind == Tag.LONG else literal(value))

    def _at(self, t: Table, e: int) -> Column:
        return F.col(t.key or "row__") == (e & (1 << SHIFT) - 1) if e >> SHIFT == t.number else F.lit(False)

    def group(self, p: Pattern) -> object | None:
        found = self.owner.get(p.attribute) if not isinstance(p.attribute, Var) else None
        return found[0].name if found else None

    def star(self, patterns: list[Pattern]) -> Relation:
        """One scan: each attribute is single-valued for an entity."""
        t = self.owner[patterns[0].attribute][0]
        df = self.frame(t)
        columns: dict[str, tuple[Column, Tag, int]] = {}
        e = patterns[0].entity
        if isinstance(e, Var):
            columns[e.name] = (F.col(t.key or "row__").cast("bigint"), Tag.REF, t.number << SHIFT)
        else:
            df = df.where(self._at(t, e))
        for p in patterns:
            x = self.owner[p.attribute][1]
            if isinstance(p.value, Value):
                df = df.where(self._is(x, p.value))
                continue
            df = df.where(F.col(x.column).isNotNull())
            own = (F.col(x.column).cast(NATIVE[x.kind]), x.kind, (x.table or 0) << SHIFT)
            same = columns.setdefault(p.value.name, own)
            if same is not own:
                df = df.where(same[0] == own[0] if same[1:] == own[1:] else F.lit(False) if same[1] != x.kind or same[2] and own[2] else same[0] + F.lit(same[2]) == own[0] + F.lit(own[2]))
        return Relation(df.select(*[c.alias(n) for n, (c, _, _) in columns.items()]), {n: k for n, (_, k, _) in columns.items()}, {n: o for n, (_, _, o) in columns.items() if o})

    def facts(self, entity: int | None, attribute: int | None, value: Value | None) -> DataFrame:
        """One scan for each table that can have such facts, and what defines the attributes."""
        out = self.spark.createDataFrame(self.definitions, DATOM).select(*FACT)
        for t in self.tables.values():
            own = [(a, x) for a, (u, x) in self.owner.items() if u is t and attribute in (None, a) and (value is None or value.tag == x.kind)]
            if not own or entity is not None and entity >> SHIFT != t.number:
                continue
            df = self.frame(t)
            if entity is not None:
                df = df.where(self._at(t, entity))
            if value is not None:
                some = F.lit(False)
                for _, x in own:
                    some = some | self._is(x, value)
                df = df.where(some)
            facts = [F.struct(F.lit(a).cast("bigint").alias("a"), F.struct(*flat(x.kind, self._value(x))).cast(ANY).alias("v"), F.col(x.column).isNotNull().alias("there")) for a, x in own]
            rows = df.select(self._entity(t).alias("e"), F.explode(F.array(*facts)).alias("f")).where("f.there")
            out = out.unionByName(rows.select("e", "f.a", "f.v.*"))
        return out

    def datoms(self, tx: int) -> DataFrame:
        """All facts of the tables as additions of one transaction."""
        data = self.facts(None, None, None).where(F.col("e") >= 1 << SHIFT)
        return data.select(*FACT, F.lit(tx).cast("bigint").alias("tx"), F.lit(False).alias("retracted"))


def _t(name: str, number: int, key: str | None, *attributes: tuple) -> Table:
    return Table(name, number, key, tuple(Attribute(*a) for a in attributes))


#: The benchmark tables: numbers, keys and attributes.
BENCHMARK = (
    _t("region", 1, "r_regionkey", ("region:name", "r_name", Tag.STRING)),
    _t("nation", 2, "n_nationkey", ("nation:name", "n_name", Tag.STRING), ("nation:region", "n_regionkey", Tag.REF, 1)),
    _t("customer", 3, "c_custkey", ("customer:name", "c_name", Tag.STRING), ("customer:segment", "c_mktsegment", Tag.STRING), ("customer:nation", "c_nationkey", Tag.REF, 2)),
    _t("supplier", 4, "s_suppkey", ("supplier:name", "s_name", Tag.STRING), ("supplier:nation", "s_nationkey", Tag.REF, 2)),
    _t("part", 5, "p_partkey", ("part:name", "p_name", Tag.STRING), ("part:brand", "p_brand", Tag.STRING), ("part:type", "p_type", Tag.STRING), ("part:size", "p_size", Tag.LONG)),
    _t("orders", 6, "o_orderkey", ("orders:customer", "o_custkey", Tag.REF, 3), ("orders:status", "o_orderstatus", Tag.STRING), ("orders:priority", "o_orderpriority", Tag.STRING), ("orders:date", "o_orderdate", Tag.TIMESTAMP)),
    _t(
        "lineitem", 7, None,
        ("lineitem:order", "l_orderkey", Tag.REF, 6), ("lineitem:part", "l_partkey", Tag.REF, 5), ("lineitem:supplier", "l_suppkey", Tag.REF, 4),
        ("lineitem:number", "l_linenumber", Tag.LONG), ("lineitem:returnflag", "l_returnflag", Tag.STRING), ("lineitem:status", "l_linestatus", Tag.STRING), ("lineitem:shipdate", "l_shipdate", Tag.TIMESTAMP),
    ),
    _t("events", 8, "event_id", ("event:type", "event_type", Tag.STRING), ("event:props", "props", Tag.STRING), ("event:user", "user_id", Tag.LONG), ("event:ts", "ts", Tag.TIMESTAMP)),
)


def benchmark_source(spark: SparkSession, sf_dir: str) -> Mapped:
    return Mapped(spark, BENCHMARK, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
