"""Connections that write, and databases: immutable snapshots that answer queries."""

from __future__ import annotations

import copy
import datetime as dt
import os
import socket
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asserta.functions.values import ANY, NATIVE, flat, matches, shown
from asserta.model import DATOM, FACT, Clause, Command, Fact, FactError, NewEntity, Query, Retract, Tag, Tx, TxReport, TypeMismatch, UnknownAttribute, Value, Var, datom, timestamp
from asserta.operators import facts as views
from asserta.operators.relational import Relation
from asserta.plans.binder import Pattern, pattern
from asserta.plans.compiler import Source, compiled, fetch
from asserta.plans.parser import parse_input, parse_query, parse_tx
from asserta.schema import IDENT, TX_TIMESTAMP, VALUE_TYPE, Schema
from asserta.sources.store import LOG_LIMIT, Manifest, Store, open_store
from asserta.sources.workspace import delete_path

#: What a dump shows, and its columns.
DUMP = parse_query("find ?ent ?attname ?val where (?ent ?att ?val) (?att db:ident ?attname)")
#: A sample: rivers, and what they flow into.
SAMPLE_SCHEMA = "{db:ident river db:valueType db:type:string} {db:ident flows:into db:valueType db:type:ref}"
SAMPLE = 'add (700 river "Danube") add (701 river "Inn") add (702 river "Isar") add (701 flows:into 700) add (702 flows:into 700)'


class Recorded:
    """A source over recorded facts. A function gives the datoms, for one attribute if that is all that is wanted, in
    files by value or by entity; another one, where there is one, the facts that are true at max_tx."""

    def __init__(self, schema: Schema, datoms: Callable[[int | None, str], DataFrame], max_tx: int | None = None, now: Callable[[int | None, str], DataFrame] | None = None):
        self.schema, self.datoms, self.max_tx, self.now = schema, datoms, max_tx, now
        self.kept: dict[int, DataFrame] = {}

    def record(self, attribute: int | None = None, order: str = "value") -> DataFrame:
        rows = self.datoms(attribute, order)
        return rows if self.max_tx is None else views.as_of(rows, self.max_tx)

    def facts(self, entity: int | None, attribute: int | None, value: Value | None) -> DataFrame:
        if attribute in self.kept:
            return self.kept[attribute]
        order = "value" if entity is None else "entity"
        return self.now(attribute, order) if self.now else views.current(self.record(attribute, order))

    def group(self, p: Pattern) -> object | None:
        return None

    def star(self, patterns: list[Pattern]) -> Relation:
        raise NotImplementedError


class Db:
    """What was true at one point. Queries on it always give the same answers."""

    def __init__(self, source: Source):
        self.source = source

    @classmethod
    def of_datoms(cls, datoms: DataFrame, schema: Schema | None = None, max_tx: int | None = None) -> Db:
        """Over a DataFrame of datoms. The schema is read from the datoms if not given; it is as small as the number
        of attributes."""
        return cls(Recorded(schema or schema_of(datoms, max_tx), lambda a, order: datoms, max_tx))

    @property
    def schema(self) -> Schema:
        return self.source.schema

    def relation(self, query: str | Query) -> Relation:
        return compiled(parse_query(query) if isinstance(query, str) else query, self.source)

    def query(self, query: str | Query) -> DataFrame:
        """A column for each variable of `find`; of any kind of value a struct (tag, s, n, ts)."""
        return self.relation(query).frame

    def text(self, query: str | Query) -> DataFrame:
        """As `query`, with values as they are written."""
        r = self.relation(query)
        names = list(r.frame.columns)
        frame = r.frame.toDF(*[f"c{i}" for i in range(len(names))])
        return frame.select(*[shown(F.col(f"c{i}"), r.kinds[n]).alias(n) for i, n in enumerate(names)])

    def fetch(self, clause: Clause) -> DataFrame:
        return fetch(self.source, pattern(clause, self.schema)).frame

    def records_matching(self, clause: Clause, binding: dict[str, Value] | None = None) -> DataFrame:
        """The recorded operations, retractions too, on facts that fit a clause once `binding` replaces its
        variables. An entity or attribute bound to another kind of value raises TypeMismatch."""
        p = pattern(substituted(clause, binding or {}, self.schema), self.schema)
        rows = self.record().where(F.lit(True) if isinstance(p.entity, Var) else F.col("e") == p.entity)
        if not isinstance(p.attribute, Var):
            rows = rows.where(F.col("a") == p.attribute)
        if isinstance(p.value, Value):
            rows = rows.where(matches(p.value))
        same: dict[str, list[str]] = {}
        for name, term in (("e", p.entity), ("a", p.attribute), ("v", p.value)):
            if isinstance(term, Var):
                same.setdefault(term.name, []).append(name)
        for names in same.values():
            if "e" in names and "a" in names:
                rows = rows.where("e = a")
            if len(names) > 1 and "v" in names:
                rows = rows.where((F.col("tag") == int(Tag.REF)) & (F.col("n") == F.col(names[0])))
        return rows

    def record(self) -> DataFrame:
        """All operations, retractions too."""
        if not isinstance(self.source, Recorded):
            raise FactError("tables have no record of operations")
        return self.source.record()

    history = record

    def as_of(self, tx: int) -> Db:
        """The database when transaction `tx` was done, names and kinds too."""
        if not isinstance(self.source, Recorded):
            raise FactError("tables have no record of operations")
        limit = tx if self.source.max_tx is None else min(tx, self.source.max_tx)
        return Db(Recorded(schema_of(self.source.datoms(None, "value"), limit), self.source.datoms, limit))

    def keep(self, *names: str) -> Db:
        """Holds the current facts of these attributes in the executors' memory, and on their disks beyond it, for all
        queries on this database. `release` lets them go."""
        for a in map(self.schema.entity, names):
            if isinstance(self.source, Recorded) and a not in self.source.kept:
                self.source.kept[a] = self.source.facts(None, a, None).where(F.col("a") == a).persist()
        return self

    def release(self) -> None:
        for frame in self.source.kept.values():
            frame.unpersist()
        self.source.kept.clear()

    def dump(self) -> DataFrame:
        """All facts with their attributes' names: ent, attname, val as text."""
        return self.text(DUMP)

    def entity(self, e: int) -> DataFrame:
        """All facts of an entity: attname and val as text."""
        return self.text(Query((Var("attname"), Var("val")), (Clause(e, Var("att"), Var("val")), Clause(Var("att"), "db:ident", Var("attname")))))


def schema_of(datoms: DataFrame, max_tx: int | None = None) -> Schema:
    rows = datoms.where(F.col("a").isin(IDENT, VALUE_TYPE))
    rows = rows if max_tx is None else views.as_of(rows, max_tx)
    return Schema.of_rows([tuple(r) for r in rows.select("e", "a", "s", "tx", "retracted").collect()])


def substituted(clause: Clause, binding: dict[str, Value], schema: Schema) -> Clause:
    """The clause with bound variables replaced."""

    def entity_of(term: Var | int | str) -> Var | int | str:
        if not isinstance(term, Var) or term.name not in binding:
            return term
        if binding[term.name].tag != Tag.REF:
            raise TypeMismatch(f"?{term.name} is no entity")
        return binding[term.name].payload

    attribute = entity_of(clause.attribute)
    if isinstance(attribute, int):
        names = [n for n, e in schema.idents.items() if e == attribute]
        if not names:
            raise UnknownAttribute(f"entity {attribute} has no name")
        attribute = names[0]
    value = binding.get(clause.value.name, clause.value) if isinstance(clause.value, Var) else clause.value
    return Clause(entity_of(clause.entity), attribute, value)


class Connection:
    """Reads without locks; writes one transaction at a time, under the store's lock while the connection is open for
    writing. A failed transaction records nothing, and ids it took aren't given again."""

    def __init__(self, spark: SparkSession, uri: str | Store, clock: Callable[[], dt.datetime] | None = None):
        self.spark = spark
        self.store = open_store(spark, uri) if isinstance(uri, str) else uri
        self.clock = clock or (lambda: dt.datetime.now(dt.timezone.utc))
        self.name = f"{socket.gethostname()}:{os.getpid()}:{uuid.uuid4().hex[:8]}"
        self.writing: Manifest | None = None

    def db(self) -> Db:
        manifest = self.store.manifest()
        if manifest is None:
            raise FactError(f"{self.store.path} has no database")
        store = self.store
        return Db(Recorded(Schema.from_json(manifest.schema), lambda a, order: store.datoms(manifest, a, order), manifest.max_tx, lambda a, order: store.now(manifest, a, order)))

    def _open(self) -> Manifest:
        if self.writing is None:
            self.store.lock(self.name)
            self.writing = self.store.take_over(self.name, self.clock())
        return self.writing

    def _id(self, manifest: Manifest) -> int:
        manifest.next_id += 1
        return manifest.next_id - 1

    def transact(self, tx: str | Tx) -> TxReport:
        """All of a transaction or nothing of it."""
        try:
            tx = parse_tx(tx) if isinstance(tx, str) else tx
            manifest = self._open()
            schema = Schema.from_json(manifest.schema)
            number = self._id(manifest)
            rows = [datom(number, TX_TIMESTAMP, timestamp(self.clock()), number)]
            made: list[int] = []

            def put(fact: Fact, retracted: bool) -> None:
                a, value = schema.checked(fact)
                rows.append(datom(fact.entity, a, value, number, retracted))
                schema.apply(fact.entity, a, value, retracted)

            for item in tx.items:
                if isinstance(item, NewEntity):
                    made.append(self._id(manifest))
                    for name, value in dict(item.attributes).items():
                        put(Fact(made[-1], name, value), False)
                else:
                    put(item.fact, isinstance(item, Retract))
        except FactError as e:
            return TxReport(error=e)
        return self._commit(number, self.spark.createDataFrame(rows, DATOM).coalesce(1), len(rows), {r[1] for r in rows}, schema, tuple(made))

    def transact_frame(self, rows: DataFrame, retract: bool = False) -> TxReport:
        """A bulk transaction of any size: rows with e, attribute (a name), tag, s, n and ts. Rows are evaluated once,
        into the store's staging folder; what was staged is checked, attributes, kinds and payloads, and then committed
        as it is. Schema attributes aren't taken in bulk."""
        try:
            manifest = self._open()
            schema = Schema.from_json(manifest.schema)
            known = [(n, e, int(schema.types[e][-1])) for n, e in schema.idents.items() if schema.types.get(e) and e not in (IDENT, VALUE_TYPE)]
            map_ = self.spark.createDataFrame(known, "attribute string, a bigint, kind tinyint")
            number = self._id(manifest)
        except FactError as e:
            return TxReport(error=e)
        path = self.store.staging(number, self.name)
        joined = rows.join(map_, "attribute", "left").select(*FACT, F.lit(retract).alias("retracted"), "attribute", "kind")
        joined.write.mode("overwrite").parquet(path)
        slots = F.when(F.col("tag").isin(0, 1), F.col("s").isNotNull()).when(F.col("tag") == int(Tag.TIMESTAMP), F.col("ts").isNotNull()).otherwise(F.col("n").isNotNull())
        good = F.coalesce(F.col("e").isNotNull() & F.col("a").isNotNull() & (F.col("tag") == F.col("kind")) & slots, F.lit(False))
        staged = self.spark.read.schema(joined.schema).parquet(path)
        # Counts alone are a hash aggregate
        counts = staged.groupBy("a").agg(F.count("*").alias("n"), F.count_if(~good).alias("wrong")).collect()
        n, attributes = sum(r["n"] for r in counts), {r["a"] for r in counts}
        if any(r["wrong"] for r in counts):
            wrong = staged.where(~good).agg(F.max(F.struct("attribute", "tag")).alias("w")).first()["w"]
            delete_path(self.spark, path)
            return TxReport(error=TypeMismatch(f"{wrong['attribute']}: no such attribute, or no value of its kind (tag {wrong['tag']})"))
        own = self.spark.createDataFrame([datom(number, TX_TIMESTAMP, timestamp(self.clock()), number)], DATOM)
        return self._commit(number, own.coalesce(1), n + 1, {*attributes, TX_TIMESTAMP}, schema, staged=True)

    def insert_frame(self, rows: DataFrame, attributes: dict[str, str]) -> TxReport:
        """A new entity for each row, of any number: `attributes` names the attribute of each column; a null is no
        fact. Ids are consecutive; the report leaves them out."""
        try:
            manifest = self._open()
            schema = Schema.from_json(manifest.schema)
            kinds = {c: schema.kind(schema.entity(name)) for c, name in attributes.items()}
            if unclear := [attributes[c] for c, k in kinds.items() if k is None]:
                raise TypeMismatch(f"{unclear[0]} has no single value type")
        except FactError as e:
            return TxReport(error=e)
        # Written first, so that rows keep their partitions while they are counted and numbered
        path = self.store.staging(manifest.next_id, f"{self.name}-rows")
        rows.select(*attributes, F.spark_partition_id().alias("part__"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place__")).write.mode("overwrite").parquet(path)
        staged = self.spark.read.parquet(path)
        counts = sorted((r[0], r[1]) for r in staged.groupBy("part__").count().collect())
        first, total = {}, manifest.next_id
        for part, n in counts:
            first[part], total = total, total + n
        manifest.next_id = total
        start = self.spark.createDataFrame(list(first.items()), "part__ int, first__ bigint")
        facts = [F.struct(F.lit(attributes[c]).alias("attribute"), F.struct(*flat(k, F.col(f"`{c}`").cast(NATIVE[k]))).cast(ANY).alias("v"), F.col(f"`{c}`").isNotNull().alias("there")) for c, k in kinds.items()]
        unfolded = staged.join(start, "part__").select((F.col("first__") + F.col("place__")).alias("e"), F.explode(F.array(*facts)).alias("f")).where("f.there")
        report = self.transact_frame(unfolded.select("e", "f.attribute", "f.v.*"))
        delete_path(self.spark, path)
        return report

    def _commit(self, number: int, rows: DataFrame, n: int, attributes: set[int], schema: Schema, made: tuple[int, ...] = (), staged: bool = False) -> TxReport:
        """Records rows, with what is staged for the transaction. If the manifest can't be published the transaction
        has failed: the next one that is committed says so."""
        after = copy.deepcopy(self.writing)
        after.schema = schema.to_json()
        try:
            self.store.append(number, rows, n, attributes, after, staged)
        except FactError as e:  # another writer has taken over
            self.writing = None
            return TxReport(error=e)
        except Exception:
            self.writing.failed.append(number)
            raise
        self.writing = after
        self.store.renew(self.name)
        self.writing = self.store.gathered(self.writing)
        if self.writing.records() > LOG_LIMIT:
            self.compact()
        return TxReport(number, made)

    def compact(self) -> None:
        self.writing = self.store.compact(self._open())

    def close(self) -> None:
        if self.writing is not None:
            self.writing = None
            self.store.unlock(self.name)

    def load_sample(self) -> None:
        for text in (SAMPLE_SCHEMA, SAMPLE):
            report = self.transact(text)
            if not report.ok:
                raise report.error

    def run(self, text: str) -> DataFrame | TxReport | None:
        """What a line of text asks for: a query's or dump's rows as text, a transaction's report, or the sample."""
        said = parse_input(text)
        if isinstance(said, Query):
            return self.db().text(said)
        if isinstance(said, Tx):
            return self.transact(said)
        return self.load_sample() if said == Command("test") else self.db().dump()


class PreparedQuery:
    """A query read once, to be run on any database."""

    def __init__(self, text: str):
        self.query = parse_query(text)

    def run(self, db: Db) -> list[list]:
        """Rows of plain Python values; the caller's memory holds them all."""
        return [list(r) for r in db.query(self.query).collect()]
