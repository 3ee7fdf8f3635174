"""The registered queries: one or more for each operator, over the benchmark tables, with the same in DuckDB's SQL.

An entity is shown as its table's key. Queries over recorded facts load tables' facts as datoms, with transactions
that retract or repeat some of them."""

from __future__ import annotations

import atexit
import shutil
import sqlite3
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asserta.db import Connection, Db, PreparedQuery
from asserta.functions.values import shown
from asserta.model import FACT, Clause, Constraint, Query, Tag, Value, Var, string
from asserta.operators.facts import coalesced, current
from asserta.operators.relational import Relation, joined, projected
from asserta.sources.mapping import BENCHMARK, SHIFT, Mapped, benchmark_source, entity
from asserta.sources.store import SqlStore, Store
from asserta.sources.workspace import new_path
from asserta.streaming.tail import follow

Run = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Run, str | None]] = {}
MASK = (1 << SHIFT) - 1


def register(name: str, sql: str | None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        REGISTRY[name] = (run, sql)
        return run

    return add


def key(column: str):
    return F.col(column).bitwiseAND(F.lit(MASK))


def keyed(frame: DataFrame, /, **columns: str) -> DataFrame:
    """Columns renamed; those of entities (name ending in `key`) as keys, and timestamps without a zone as in the files."""
    out = []
    for new, old in columns.items():
        c = key(old) if new.endswith("key") else F.col(old)
        out.append((c.cast("timestamp_ntz") if dict(frame.dtypes)[old] == "timestamp" else c).alias(new))
    return frame.select(*out)


def of_text(name: str, query: str, sql: str, /, **columns: str) -> None:
    """A query over the tables as virtual facts."""
    register(name, sql)(lambda spark, sf_dir: keyed(Db(benchmark_source(spark, sf_dir)).query(query), **columns))


# Fetch, by what is bound
of_text("fetch_attr_value_string", 'find ?c where (?c customer:segment "BUILDING")', "SELECT c_custkey AS ckey FROM customer WHERE c_mktsegment = 'BUILDING'", ckey="c")
of_text("fetch_attr_value_ref", f"find ?c where (?c customer:nation {entity(2, 3)})", "SELECT c_custkey AS ckey FROM customer WHERE c_nationkey = 3", ckey="c")
of_text("fetch_attr_value_long", "find ?p where (?p part:size 15)", "SELECT p_partkey AS pkey FROM part WHERE p_size = 15", pkey="p")
of_text("fetch_attr_value_indexed", 'find ?o where (?o orders:status "F")', "SELECT o_orderkey AS okey FROM orders WHERE o_orderstatus = 'F'", okey="o")
of_text("fetch_entity_attr", f"find ?n where ({entity(2, 3)} nation:name ?n)", "SELECT n_name AS n FROM nation WHERE n_nationkey = 3", n="n")
of_text("fetch_attr_only", "find ?o ?s where (?o orders:status ?s)", "SELECT o_orderkey AS okey, o_orderstatus AS s FROM orders", okey="o", s="s")
of_text("fetch_timestamp_attr", "find ?o ?d where (?o orders:date ?d)", "SELECT o_orderkey AS okey, o_orderdate AS d FROM orders", okey="o", d="d")
of_text(
    "fetch_all_bound_semi",
    f'find ?c where (?c customer:nation {entity(2, 3)}) ({entity(2, 3)} nation:region {entity(1, 3)})',
    "SELECT c_custkey AS ckey FROM customer WHERE c_nationkey = 3 AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3 AND n_regionkey = 3)",
    ckey="c",
)


def as_text(name: str, query: str, sql: str, key_of: tuple[str, ...] = ()) -> None:
    """A query whose values are shown as text, since their kinds vary."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = Db(benchmark_source(spark, sf_dir)).relation(query)
        return r.frame.select(*[(key(c) if c in key_of else shown(F.col(c), r.kinds[c])).alias(c) for c in r.frame.columns])

    register(name, sql)(run)


NAMED = " (?a db:ident ?name)"
CUSTOMER = f"""
    SELECT c_custkey AS e, 'customer:name' AS name, '"' || c_name || '"' AS v FROM customer UNION ALL SELECT c_custkey, 'customer:segment', '"' || c_mktsegment || '"' FROM customer
    UNION ALL SELECT c_custkey, 'customer:nation', CAST(c_nationkey + {2 << SHIFT} AS VARCHAR) FROM customer"""


def every_fact(numbers: tuple[int, ...]) -> str:
    """All facts of mapped tables that have a key: e, name, and the value as text."""
    shows = {Tag.STRING: "'\"' || {} || '\"'", Tag.TIMESTAMP: "rtrim(rtrim(strftime({}, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')", Tag.LONG: "CAST({} AS VARCHAR)"}
    parts = []
    for t in (t for t in BENCHMARK if t.number in numbers):
        for x in t.attributes:
            value = f"CAST({x.column} + {x.table << SHIFT} AS VARCHAR)" if x.table else shows[x.kind].format(x.column)
            parts.append(f"SELECT CAST({t.key} + {t.number << SHIFT} AS BIGINT) AS e, '{x.name}' AS name, {value} AS v FROM {t.name} WHERE {x.column} IS NOT NULL")
    return " UNION ALL ".join(parts)


KEYED = tuple(t.number for t in BENCHMARK if t.key)
as_text("fetch_entity_only", f"find ?name ?v where ({entity(3, 5)} ?a ?v){NAMED}", f"SELECT name, v FROM ({CUSTOMER}) WHERE e = 5")
as_text(
    "fetch_value_only",
    'find ?e ?name where (?e ?a "BUILDING")' + NAMED,
    "SELECT c_custkey AS e, 'customer:segment' AS name FROM customer WHERE c_mktsegment = 'BUILDING'",
    ("e",),
)
as_text("fetch_entity_value", f"find ?name where ({entity(2, 3)} ?a {entity(1, 3)}){NAMED}", "SELECT 'nation:region' AS name FROM nation WHERE n_nationkey = 3 AND n_regionkey = 3")


@register("fetch_full_scan", every_fact(KEYED))
def fetch_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of all tables that have a key, by an unbound pattern."""
    whole = benchmark_source(spark, sf_dir)
    r = Db(Mapped(spark, tuple(whole.tables[n] for n in KEYED), whole.read)).relation("find ?e ?name ?v where (?e ?a ?v)" + NAMED)
    return r.frame.where(F.col("e") >= 1 << SHIFT).select("e", "name", shown(F.col("v"), r.kinds["v"]).alias("v"))


# Joins
of_text(
    "lookup_chain",
    "find ?num ?name ?nation where (?l lineitem:order ?o) (?l lineitem:number ?num) (?o orders:customer ?c) (?c customer:name ?name) (?c customer:nation ?n) (?n nation:name ?nation)",
    "SELECT CAST(l_linenumber AS BIGINT) AS num, c_name AS name, n_name AS nation FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    num="num", name="name", nation="nation",
)
of_text(
    "hash_join_two_relations",
    "find ?c ?region where (?c customer:nation ?n) (?r region:name ?region) (?n nation:region ?r)",
    "SELECT c_custkey AS ckey, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ckey="c", region="region",
)
of_text(
    "join_multi_shared_vars",
    "find ?o ?p ?x ?y where (?a lineitem:order ?o) (?a lineitem:part ?p) (?a lineitem:number ?x) (?b lineitem:order ?o) (?b lineitem:part ?p) (?b lineitem:number ?y) (< ?x ?y)",
    "SELECT a.l_orderkey AS okey, a.l_partkey AS pkey, CAST(a.l_linenumber AS BIGINT) AS x, CAST(b.l_linenumber AS BIGINT) AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_linenumber < b.l_linenumber",
    okey="o", pkey="p", x="x", y="y",
)
of_text("self_join_same_nation", "find ?s ?c where (?s supplier:nation ?n) (?c customer:nation ?n)", "SELECT s_suppkey AS skey, c_custkey AS ckey FROM supplier JOIN customer ON s_nationkey = c_nationkey", skey="s", ckey="c")
of_text("cartesian_product", "find ?r ?n where (?x region:name ?r) (?y nation:name ?n)", "SELECT r_name AS r, n_name AS n FROM region CROSS JOIN nation", r="r", n="n")
of_text(
    "star_collapse",
    'find ?c ?name ?n where (?c customer:name ?name) (?c customer:segment "BUILDING") (?c customer:nation ?n)',
    "SELECT c_custkey AS ckey, c_name AS name, CAST(c_nationkey AS BIGINT) AS nkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    ckey="c", name="name", nkey="n",
)
of_text(
    "existence_clause",
    'find ?o where (?o orders:customer ?c) (?c customer:segment "MACHINERY")',
    "SELECT o_orderkey AS okey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
    okey="o",
)

# Constraints
of_text("constraint_lt", 'find ?c ?n where (?c customer:name ?n) (< ?n "Customer#000000050")', "SELECT c_custkey AS ckey, c_name AS n FROM customer WHERE c_name < 'Customer#000000050'", ckey="c", n="n")
of_text("constraint_gt", "find ?p ?s where (?p part:size ?s) (> ?s 40)", "SELECT p_partkey AS pkey, CAST(p_size AS BIGINT) AS s FROM part WHERE p_size > 40", pkey="p", s="s")
of_text("constraint_not", 'find ?o ?s where (?o orders:status ?s) (not ?s "F")', "SELECT o_orderkey AS okey, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'F'", okey="o", s="s")
of_text(
    "constraint_var_var",
    "find ?a ?b where (?x nation:name ?a) (?x nation:region ?r) (?y nation:name ?b) (?y nation:region ?r) (< ?a ?b)",
    "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name",
    a="a", b="b",
)
of_text("constraint_const_left", "find ?p where (?p part:size ?s) (< 40 ?s)", "SELECT p_partkey AS pkey FROM part WHERE 40 < p_size", pkey="p")
of_text("constraint_multi_and", "find ?p where (?p part:size ?s) (> ?s 10) (< ?s 20) (not ?s 15)", "SELECT p_partkey AS pkey FROM part WHERE p_size > 10 AND p_size < 20 AND p_size <> 15", pkey="p")
of_text("constraint_ref", f"find ?n where (?n nation:region ?r) (> ?r {entity(1, 2)})", "SELECT CAST(n_nationkey AS BIGINT) AS nkey FROM nation WHERE n_regionkey > 2", nkey="n")
of_text("constraint_cross_type", "find ?n where (?x region:name ?n) (< ?n 5)", "SELECT r_name AS n FROM region", n="n")
of_text("constraint_cross_type_never", "find ?n where (?x region:name ?n) (> ?n 5)", "SELECT r_name AS n FROM region WHERE false", n="n")
of_text("constraint_theta_product", "find ?a ?b where (?x region:name ?a) (?y nation:name ?b) (> ?b ?a)", "SELECT r_name AS a, n_name AS b FROM region JOIN nation ON n_name > r_name", a="a", b="b")
of_text("project_reorder_bag", "find ?s ?n where (?c customer:nation ?n) (?c customer:segment ?s)", "SELECT c_mktsegment AS s, CAST(c_nationkey AS BIGINT) AS nkey FROM customer", s="s", nkey="n")
of_text(
    "join_free_attribute_with_table",
    'find ?c ?n where (?c ?a "BUILDING") (?c customer:nation ?n)',
    "SELECT c_custkey AS ckey, CAST(c_nationkey AS BIGINT) AS nkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    ckey="c", nkey="n",
)
of_text("join_different_tables_never", "find ?c ?n where (?c customer:nation ?x) (?x customer:name ?n)", "SELECT c_custkey AS ckey, c_name AS n FROM customer WHERE false", ckey="c", n="n")
of_text("constraint_refs_of_two_tables", "find ?n ?r where (?n nation:region ?r) (> ?n ?r)", "SELECT CAST(n_nationkey AS BIGINT) AS nkey, CAST(n_regionkey AS BIGINT) AS rkey FROM nation", nkey="n", rkey="r")
of_text("constraint_refs_of_one_table", "find ?a ?b where (?a nation:region ?r) (?b nation:region ?r) (< ?a ?b)", "SELECT CAST(a.n_nationkey AS BIGINT) AS akey, CAST(b.n_nationkey AS BIGINT) AS bkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", akey="a", bkey="b")


# The algebra itself, without the language
@register("natural_join_relations", "SELECT s_suppkey AS supplier, n_name AS name, CAST(n_nationkey AS BIGINT) AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def natural_join_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two relations built by hand; the join's key, then columns of the right one, put in another order."""
    left = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").cast("bigint").alias("nation"), F.col("s_suppkey").alias("supplier"))
    right = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("nation"), F.col("n_name").alias("name"))
    both = joined(Relation(left, {"nation": Tag.LONG, "supplier": Tag.LONG}), Relation(right, {"nation": Tag.LONG, "name": Tag.STRING}))
    return projected(both, (Var("supplier"), Var("name"), Var("nation"))).frame


@register("built_query", "SELECT c_custkey AS ckey FROM customer WHERE c_mktsegment > 'FURNITURE' AND c_nationkey = 7")
def built_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query as data in place of text."""
    c, s = Var("c"), Var("s")
    q = Query((c,), (Clause(c, "customer:segment", s), Clause(c, "customer:nation", Value(Tag.REF, entity(2, 7)))), (Constraint(">", s, string("FURNITURE")),))
    return keyed(Db(benchmark_source(spark, sf_dir)).query(q), ckey="c")


# Recorded facts
def recorded(spark: SparkSession, sf_dir: str, table: int, changes: Callable[[DataFrame], list[tuple[DataFrame, int, bool]]]) -> tuple[DataFrame, Mapped]:
    """A table's facts as datoms of transaction 20, the attributes' definitions, and further operations on them."""
    whole = benchmark_source(spark, sf_dir)
    source = Mapped(spark, (whole.tables[table],), whole.read)
    data = source.datoms(20)
    out = data.unionByName(spark.createDataFrame(source.definitions, data.schema))
    for rows, tx, retracted in changes(data):
        out = out.unionByName(rows.select(*FACT, F.lit(tx).cast("bigint").alias("tx"), F.lit(retracted).alias("retracted")))
    return out, source


def third(data: DataFrame) -> DataFrame:
    """Facts of the keys that 3 divides."""
    return data.where(key("e") % 3 == 0)


STATUS = "find ?o ?s where (?o orders:status ?s)"
KEPT = "SELECT o_orderkey AS okey, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0"
ALL = "SELECT o_orderkey AS okey, o_orderstatus AS s FROM orders"


def over_record(name: str, sql: str, changes: Callable[[DataFrame], list[tuple[DataFrame, int, bool]]], as_of: int | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        datoms, source = recorded(spark, sf_dir, 6, changes)
        return keyed(Db.of_datoms(datoms, source.schema, as_of).query(STATUS), okey="o", s="s")

    register(name, sql)(run)


over_record("retraction_visible", KEPT, lambda d: [(third(d), 30, True)])
over_record("re_assert", ALL, lambda d: [(third(d), 30, True), (third(d), 40, False)])
over_record("double_assert", ALL, lambda d: [(third(d), 30, False)])
over_record("double_assert_one_retract", KEPT, lambda d: [(third(d), 30, False), (third(d), 40, True)])
over_record("retract_never_asserted", ALL, lambda d: [(d.select("e", "a", "tag", F.concat("s", F.lit("-")).alias("s"), "n", "ts").where("s is not null"), 30, True)])
over_record("add_and_retract_in_one_tx", KEPT, lambda d: [(third(d), 30, False), (third(d), 30, True)])
over_record("as_of_tx", ALL, lambda d: [(third(d), 30, True)], 25)


@register("history_count", "SELECT count(*) + count(*) FILTER (o_orderkey % 3 = 0) AS operations FROM (SELECT o_orderkey, unnest([1, 2, 3, 4]) FROM orders)")
def history_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    datoms, source = recorded(spark, sf_dir, 6, lambda d: [(third(d), 30, True)])
    return Db.of_datoms(datoms, source.schema).history().where(F.col("e") >= 1 << SHIFT).agg(F.count("*").alias("operations"))


@register("record_coalesced", "SELECT tx, retracted, 4 * (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS n FROM (VALUES (20::BIGINT, false), (40, true), (50, false)) t(tx, retracted)")
def record_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added twice, retracted, added: the repeated addition goes from the record."""
    datoms, _ = recorded(spark, sf_dir, 6, lambda d: [(third(d), 30, False), (third(d), 40, True), (third(d), 50, False)])
    return coalesced(third(datoms.where(F.col("e") >= 1 << SHIFT))).groupBy("tx", "retracted").agg(F.count("*").alias("n"))


@register("records_matching", "SELECT o_orderkey AS okey, false AS retracted FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, true FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0")
def records_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    datoms, source = recorded(spark, sf_dir, 6, lambda d: [(third(d), 30, True)])
    found = Db.of_datoms(datoms, source.schema).records_matching(Clause(Var("o"), "orders:status", Var("s")), {"s": string("F")})
    return found.select(key("e").alias("okey"), "retracted")


@register("self_unify", "SELECT n_nationkey + 0::BIGINT AS nkey FROM nation WHERE n_nationkey % 2 = 0")
def self_unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(?x a ?x): facts that refer to their own entity; here even nations get one, odd ones another's."""
    datoms, source = recorded(spark, sf_dir, 2, lambda d: [])
    region = source.schema.entity("nation:region")
    own = datoms.where((F.col("a") == region) & (F.col("tx") == 20))
    looped = own.withColumn("n", F.when(key("e") % 2 == 0, F.col("e")).otherwise(F.col("e") + 1))
    return keyed(Db.of_datoms(looped, source.schema).query("find ?x where (?x nation:region ?x)"), nkey="x")


@register("implicit_join_attr_var", "SELECT 'customer:segment' AS name, c_custkey AS ckey FROM customer WHERE c_mktsegment = 'BUILDING'")
def implicit_join_attr_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable attribute bound by its name over recorded facts."""
    datoms, source = recorded(spark, sf_dir, 3, lambda d: [])
    return keyed(Db.of_datoms(datoms, source.schema).query('find ?name ?c where (?a db:ident ?name) (?c ?a "BUILDING")'), name="name", ckey="c")


@register("dump", f"SELECT e AS ent, name AS attname, v AS val FROM ({every_fact((6,))})")
def dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    datoms, source = recorded(spark, sf_dir, 6, lambda d: [])
    return Db.of_datoms(datoms, source.schema).dump().withColumn("ent", F.col("ent").cast("bigint")).where(F.col("ent") >= 1 << SHIFT)


@register("schema_attributes", "SELECT * FROM (VALUES ('nation:name', 'db:type:string'), ('nation:region', 'db:type:ref')) t(name, kind)")
def schema_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema is facts as well."""
    datoms, source = recorded(spark, sf_dir, 2, lambda d: [])
    return Db.of_datoms(datoms, source.schema).query("find ?name ?kind where (?a db:ident ?name) (?a db:valueType ?kind) (> ?a 10)")


def stored(spark: SparkSession, sf_dir: str, store: Store | None = None) -> Connection:
    """A store on disk with nations in bulk, then a transaction that retracts and one that adds a name."""
    source = benchmark_source(spark, sf_dir)
    c = Connection(spark, store or Store(spark, new_path(spark, "store")))
    said = c.transact("{db:ident nation:name db:valueType db:type:string} {db:ident nation:region db:valueType db:type:ref}")
    names = Mapped(spark, (source.tables[2],), source.read)
    rows = names.datoms(0).join(spark.createDataFrame([(a, x.name) for a, (_, x) in names.owner.items()], "a bigint, attribute string"), "a").drop("a")
    for report in (said, c.transact_frame(rows), c.transact_frame(rows.where(key("e") % 3 == 0), retract=True), c.transact(f'add ({entity(2, 0)} nation:name "again")')):
        if not report.ok:
            raise report.error
    return c


STORED = f"SELECT CAST(n_nationkey AS BIGINT) AS nkey, n_name AS n FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT 0, 'again'"


@register("store_transactions", STORED)
def store_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stored(spark, sf_dir)
    c.close()
    return keyed(c.db().query("find ?e ?n where (?e nation:name ?n)"), nkey="e", n="n")


@register("compaction_invariant", STORED)
def compaction_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stored(spark, sf_dir)
    c.compact()
    c.close()
    return keyed(c.db().query("find ?e ?n where (?e nation:name ?n)"), nkey="e", n="n")


@register("tx_entity_query", "SELECT * FROM (VALUES (0::BIGINT), (10), (13), (14), (15)) t(tx)")
def tx_entity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions are entities with a time; the times themselves differ from run to run."""
    c = stored(spark, sf_dir)
    c.close()
    return c.db().query("find ?tx ?at where (?tx db:txTimestamp ?at)").select("tx")


def loaded(spark: SparkSession, sf_dir: str, uri: str | None = None) -> tuple[Connection, DataFrame]:
    """A store with all orders, taken in bulk; and the rows taken, with their attributes' names."""
    source = benchmark_source(spark, sf_dir)
    orders = Mapped(spark, (source.tables[6],), source.read)
    c = Connection(spark, uri or Store(spark, new_path(spark, "store")))
    said = c.transact(" ".join(f"{{db:ident {x.name} db:valueType db:type:{x.kind.name.lower()}}}" for _, x in orders.owner.values()))
    rows = orders.datoms(0).join(F.broadcast(spark.createDataFrame([(a, x.name) for a, (_, x) in orders.owner.items()], "a bigint, attribute string")), "a").drop("a", "tx", "retracted")
    for report in (said, c.transact_frame(rows)):
        if not report.ok:
            raise report.error
    return c, rows


@register("bulk_load_store", KEPT)
def bulk_load_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders through a connection, a third of them retracted in bulk, then compacted: read from the base."""
    c, rows = loaded(spark, sf_dir)
    c.transact_frame(rows.where(key("e") % 3 == 0), retract=True)
    c.compact()
    c.close()
    return keyed(c.db().query(STATUS), okey="o", s="s")


@register("store_entity_lookup", "SELECT 'orders:status' AS name, '\"' || o_orderstatus || '\"' AS v FROM orders WHERE o_orderkey = 7 UNION ALL SELECT 'orders:customer', CAST(o_custkey + 3298534883328 AS VARCHAR) FROM orders WHERE o_orderkey = 7")
def store_entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity's facts from the compacted base in entity order."""
    c, _ = loaded(spark, sf_dir)
    c.compact()
    c.close()
    r = c.db().relation(f"find ?name ?v where ({entity(6, 7)} ?a ?v)" + NAMED)
    return r.frame.select("name", shown(F.col("v"), r.kinds["v"]).alias("v")).where(F.col("name").isin("orders:status", "orders:customer"))


@register("store_value_lookup", "SELECT o_orderkey AS okey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 1 FROM orders WHERE o_orderkey = 1 AND o_orderstatus <> 'P'")
def store_value_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value's entities from the compacted base and a log on top of it."""
    c, _ = loaded(spark, sf_dir)
    c.compact()
    c.transact(f'add ({entity(6, 1)} orders:status "P")')
    c.close()
    return keyed(c.db().query('find ?o where (?o orders:status "P")'), okey="o")


@register("sqlite_store", STORED)
def sqlite_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest and lock in a SQLite file of the driver, facts in a shared folder."""
    folder = tempfile.mkdtemp(prefix="asserta-sqlite-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    store = SqlStore(spark, new_path(spark, "store"), lambda: sqlite3.connect(f"{folder}/manifest.db", timeout=30), "?")
    c = stored(spark, sf_dir, store)
    c.close()
    return keyed(c.db().query("find ?e ?n where (?e nation:name ?n)"), nkey="e", n="n")


@register("text_retract", "SELECT CAST(n_nationkey AS BIGINT) AS nkey, n_name AS n FROM nation WHERE n_nationkey % 3 <> 0")
def text_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retraction as text."""
    c = stored(spark, sf_dir)
    report = c.transact(f'retract ({entity(2, 0)} nation:name "again")')
    if not report.ok:
        raise report.error
    c.close()
    return keyed(c.db().query("find ?e ?n where (?e nation:name ?n)"), nkey="e", n="n")


@register("failed_commit", STORED)
def failed_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction whose manifest can't be published isn't there; those before and after it are."""
    c = stored(spark, sf_dir)
    publish = c.store.publish
    c.store.publish = _broken
    try:
        c.transact(f'add ({entity(2, 1)} nation:name "ghost")')
    except OSError:
        c.store.publish = publish
    report = c.transact(f'add ({entity(2, 0)} nation:name "again")')
    if not report.ok:
        raise report.error
    c.close()
    return keyed(c.db().query("find ?e ?n where (?e nation:name ?n)"), nkey="e", n="n")


def _broken(manifest: object) -> None:
    raise OSError("no manifest today")


@register("prepared_query", "SELECT CAST(n_nationkey AS BIGINT) AS nkey, n_name AS n FROM nation WHERE n_regionkey = 3")
def prepared_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = PreparedQuery(f"find ?e ?n where (?e nation:name ?n) (?e nation:region {entity(1, 3)})").run(Db(benchmark_source(spark, sf_dir)))
    return keyed(spark.createDataFrame(rows, "e bigint, n string"), nkey="e", n="n")


@register("follow_log", "SELECT CAST(n_nationkey AS BIGINT) AS nkey, n_name AS n, retracted FROM nation, (VALUES (false), (true)) t(retracted) WHERE NOT retracted OR n_nationkey % 3 = 0 UNION ALL SELECT 0, 'again', false")
def follow_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a follower of the log is told of the names: committed operations, in spite of a failed one."""
    c = stored(spark, sf_dir)
    publish = c.store.publish
    c.store.publish = _broken
    try:
        c.transact(f'add ({entity(2, 1)} nation:name "ghost")')
    except OSError:
        c.store.publish = publish
    c.transact(f"add ({entity(2, 1)} nation:region {entity(1, 4)})")
    c.close()
    out = new_path(spark, "followed")
    follow(c.store, lambda rows, number: rows.write.mode("append").parquet(out), new_path(spark, "follow"), once=True).awaitTermination()
    a = c.db().schema.entity("nation:name")
    return keyed(spark.read.parquet(out).where(F.col("a") == a), nkey="e", n="s", retracted="retracted")


@register("bulk_load_current", "SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def bulk_load_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current-facts view of the largest keyed table, counted by a value."""
    datoms, source = recorded(spark, sf_dir, 8, lambda d: [])
    a = source.schema.entity("event:type")
    return current(datoms).where(F.col("a") == a).groupBy(F.col("s").alias("type")).agg(F.count("*").alias("n"))
