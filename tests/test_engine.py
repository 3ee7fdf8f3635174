"""Text to rows on a small database of rivers, and the store beneath it."""

import datetime as dt
import io
import sys

import pytest

from asserta import cli
from asserta.db import Connection, Db, PreparedQuery
from asserta.functions.render import table
from asserta.model import DATOM, Clause, FactError, TypeMismatch, UnboundVariable, UnknownAttribute, Value, Var, datom, ident, ref, string
from asserta.model import Tag
from asserta.server import RemoteConnection, TransactorService
from asserta.sources import store as stores
from asserta.sources.workspace import new_path

CLOCK = dt.datetime(2020, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc)
SCHEMA = "{db:ident river db:valueType db:type:string} {db:ident into db:valueType db:type:ref} {db:ident town db:valueType db:type:string} {db:ident length db:valueType db:type:long}"
FACTS = 'add (500 river "Danube") add (501 river "Inn") add (502 river "Isar") add (503 river "Elbe") add (501 into 500) add (502 into 500) add (600 town "Passau") add (600 into 500) add (500 length 2850) add (502 length 295)'


@pytest.fixture(scope="module")
def rivers(spark):
    c = Connection(spark, new_path(spark, "rivers"), lambda: CLOCK)
    assert c.transact(SCHEMA).new_entities == (11, 12, 13, 14)
    assert c.transact(FACTS).tx == 15
    yield c
    c.close()


def rows(db, text):
    return sorted(map(tuple, PreparedQuery(text).run(db)))


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ('find ?r where (?r river "Isar")', [(502,)]),
        ("find ?n where (503 river ?n)", [("Elbe",)]),
        ("find ?r ?l where (?r length ?l)", [(500, 2850), (502, 295)]),
        ('find ?n where (?r river ?n) (< ?n "Inn")', [("Danube",), ("Elbe",)]),
        ('find ?n where (?r river ?n) (> "Inn" ?n)', [("Danube",), ("Elbe",)]),
        ("find ?l where (?r length ?l) (not ?l 295)", [(2850,)]),
        ('find ?n where (?d river "Danube") (?r into ?d) (?r river ?n)', [("Inn",), ("Isar",)]),
        ("find ?e where (?e db:ident db:type:string)", [(6,)]),
        ("find ?r where (?r river ?n) (?r town ?n)", []),
        ("find ?t ?n where (?x town ?t) (?x into ?r) (?r river ?n)", [("Passau", "Danube")]),
        ('find ?n ?t where (?r river ?n) (?x town ?t) (> ?n "F")', [("Inn", "Passau"), ("Isar", "Passau")]),
        ("find ?n ?n where (501 river ?n)", [("Inn", "Inn")]),
        ('find ?r where (?r length ?l) (501 into 500)', [(500,), (502,)]),
        ("find ?r where (?r length ?l) (501 into 502)", []),
        ("find ?r where (501 into 500) (?r length 295)", [(502,)]),
        ("find ?x where (?x into ?x)", []),
        ("find ?n where (?r river ?n) (> ?n 3)", []),
        ("find ?t where (?x town ?t) (< ?t 3)", [("Passau",)]),
        ("find ?a where (600 ?a 500)", [(12,)]),
        ("find ?name where (502 ?a 500) (?a db:ident ?name)", [("into",)]),
        ('find ?e where (?e ?a "Elbe")', [(503,)]),
        ("find ?n where (?v river ?n) (600 ?a ?v)", [("Danube",)]),
    ],
)
def test_queries(rivers, text, wanted):
    assert rows(rivers.db(), text) == wanted


def test_dump(rivers):
    db = rivers.db()
    counts = {}
    for r in db.dump().collect():
        counts[r["attname"]] = counts.get(r["attname"], 0) + 1
    assert counts == {"db:ident": 13, "db:valueType": 8, "db:txTimestamp": 3, "river": 4, "into": 3, "town": 1, "length": 2}
    assert sorted(map(tuple, db.entity(502).collect())) == [("into", "500"), ("length", "295"), ("river", '"Isar"')]
    assert '"Elbe"' in table(db.text("find ?n where (?a river ?n)"))


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ('find ?e ?n where (?e town ?n) (?n river "x")', TypeMismatch),
        ("find ?e where (?e nothing ?n)", UnknownAttribute),
        ("find ?z where (?e river ?n)", UnboundVariable),
        ("find ?e where (?e river ?n) (< ?z 3)", UnboundVariable),
    ],
)
def test_query_errors(rivers, text, error):
    with pytest.raises(error):
        rivers.db().query(text)


def test_a_name_before_its_use_as_an_entity_matches_nothing(rivers):
    assert rows(rivers.db(), 'find ?n where (?n town "x") (?e river ?n)') == []


@pytest.mark.parametrize(("text", "error"), [("add (1 nothing 2)", UnknownAttribute), ('add (1 into "x")', TypeMismatch), ("add (1 river 5)", TypeMismatch), ("retract (1 river 5)", TypeMismatch), ("{db:ident shade db:valueType db:type:colour}", FactError), ('add (1 shade "x")', UnknownAttribute)])
def test_a_bad_item_leaves_nothing(rivers, text, error):
    before = rivers.db().record().count()
    report = rivers.transact('add (99 river "half") ' + text)
    assert not report.ok and isinstance(report.error, error)
    assert rivers.db().record().count() == before and rows(rivers.db(), 'find ?e where (?e river "half")') == []


def test_fetch_and_records(rivers):
    db = rivers.db()
    assert sorted(map(tuple, db.fetch(Clause(Var("e"), "length", Var("n"))).collect())) == [(500, 2850), (502, 295)]
    assert [r["e"] for r in db.records_matching(Clause(Var("e"), "river", Var("n")), {"n": string("Inn")}).collect()] == [501]
    with pytest.raises(TypeMismatch):
        db.records_matching(Clause(Var("e"), "river", Var("n")), {"e": string("Inn")})


def test_kept_facts(rivers):
    db = rivers.db().keep("river")
    assert rows(db, 'find ?r where (?r river "Isar")') == [(502,)] and db.source.kept[11].is_cached
    db.release()
    assert rows(db, 'find ?r where (?r river "Isar")') == [(502,)] and not db.source.kept


def test_time(spark):
    """Retractions, snapshots, renames, compaction."""
    c = Connection(spark, new_path(spark, "time"), lambda: CLOCK)
    c.load_sample()
    old = c.db()
    assert c.transact("retract (702 flows:into 700)").ok
    now = c.db()
    flows = "find ?a ?b where (?a flows:into ?b)"
    assert rows(old, flows) == [(701, 700), (702, 700)] and rows(now, flows) == [(701, 700)]
    assert now.query(flows).columns == ["a", "b"]
    last = now.source.max_tx
    assert len(rows(now.as_of(last - 1), flows)) == 2
    with pytest.raises(UnknownAttribute):
        now.as_of(0).query(flows)
    assert c.transact('retract (7 river "never said")').ok
    names = [("Danube",), ("Inn",), ("Isar",)]
    assert rows(c.db(), "find ?n where (?e river ?n)") == names
    c.transact("{db:ident age db:valueType db:type:long}")
    assert c.transact("add (0 age 7) add (1 age 50) add (702 flows:into 700) retract (702 flows:into 700)").ok
    c.compact()
    assert c.db().source.datoms(None, "value").count() and not c.store.manifest().log
    assert rows(c.db(), "find ?e where (?e age ?y) (> ?y 10)") == [(1,)] and rows(c.db(), "find ?e where (?e age 7)") == [(0,)]
    assert rows(c.db(), flows) == [(701, 700)] and len(rows(c.db().as_of(last - 1), flows)) == 2
    before = c.store.manifest().base
    name = c.db().schema.entity("river")
    c.transact(f"add (705 flows:into 700) retract (701 flows:into 700) retract ({name} db:ident river) add ({name} db:ident called)")
    assert rows(c.db(), flows) == [(705, 700)] and rows(c.db(), "find ?b where (705 flows:into ?b)") == [(700,)]
    c.compact()
    after = c.store.manifest().base
    age = c.db().schema.entity("age")
    assert after[age] == before[age] and after[c.db().schema.entity("flows:into")] > before[c.db().schema.entity("flows:into")]
    assert rows(c.db(), flows) == [(705, 700)] and rows(c.db(), "find ?n where (?e called ?n)") == names
    with pytest.raises(UnknownAttribute):
        c.db().query("find ?n where (?e river ?n)")
    c.close()


def plan(frame):
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans_of_a_compacted_store(spark):
    """Both look-ups read files in their order with pushed filters, and aggregate nothing that the log doesn't touch."""
    c = Connection(spark, new_path(spark, "plans"))
    c.transact(SCHEMA)
    c.transact(FACTS)
    c.compact()
    c.transact('add (504 river "Rhine")')
    by_value = plan(c.db().query("find ?r where (?r length 295)"))
    assert "Aggregate" not in by_value and "/value/a=14" in by_value and "EqualTo(n,295)" in by_value
    by_entity = plan(c.db().query("find ?l where (502 length ?l)"))
    assert "Aggregate" not in by_entity and "/entity/a=14" in by_entity and "EqualTo(e,502)" in by_entity
    assert "HashAggregate" in plan(c.db().query("find ?r where (?r river ?n)"))
    assert "Cartesian" not in plan(c.db().query("find ?r where (?r length ?l) (501 into 500)"))
    c.close()


@pytest.fixture(params=["folder", "sqlite"])
def uri(spark, request, tmp_path):
    return new_path(spark, "writer") if request.param == "folder" else f"sqlite://{tmp_path}/facts.db"


def test_one_writer(spark, uri, monkeypatch):
    first, second = Connection(spark, uri), Connection(spark, uri)
    with pytest.raises(FactError):
        first.db()
    assert first.transact("{db:ident a db:valueType db:type:ref}").ok
    report = second.transact("add (1 a 2)")
    assert not report.ok and "writer" in str(report.error)
    first.close()
    assert second.transact("add (1 a 2)").ok and rows(first.db(), "find ?x where (?x a ?y)") == [(1,)]
    # A lease that has run out is taken over, and who lost it records nothing more
    monkeypatch.setattr(stores, "LEASE", -1.0)
    assert second.transact("add (2 a 2)").ok
    monkeypatch.setattr(stores, "LEASE", 600.0)
    assert first.transact("add (3 a 2)").ok
    report = second.transact("add (4 a 2)")
    assert not report.ok and "another writer" in str(report.error)
    second.close()
    assert first.transact("add (5 a 2)").ok
    assert rows(first.db(), "find ?x where (?x a ?y)") == [(1,), (2,), (3,), (5,)]
    first.compact()
    first.close()
    assert rows(second.db(), "find ?x where (?x a ?y)") == [(1,), (2,), (3,), (5,)]


def test_other_uris(spark):
    for uri in ("mysql://nowhere/facts", "jdbc:postgresql://nowhere"):
        with pytest.raises(FactError):
            Connection(spark, uri)


def test_many_small_transactions(spark, monkeypatch):
    """Folders are gathered into segments, segments into larger ones."""
    monkeypatch.setattr(stores, "FOLDERS", 2)
    c = Connection(spark, new_path(spark, "small"))
    c.transact("{db:ident a db:valueType db:type:ref}")
    for k in range(12):
        assert c.transact(f"add ({k} a {k})").ok
        m = c.store.manifest()
        assert len(m.log) <= 2 and all([s[0] for s in m.segments].count(x) <= 2 for x in range(5))
    assert max(s[0] for s in m.segments) == 2
    assert c.db().as_of(m.max_tx - 1).query("find ?x where (?x a ?x)").count() == 11
    c.compact()
    assert rows(c.db(), "find ?x where (?x a ?x)") == [(k,) for k in range(12)]
    c.close()


def test_transactor(spark):
    service = TransactorService(Connection(spark, new_path(spark, "served")))
    address = service.listen(port=0)
    one, two = (RemoteConnection(spark, service.connection.store.path, address) for _ in range(2))
    assert one.transact(SCHEMA).new_entities == (11, 12, 13, 14)
    assert two.transact('add (500 river "Po")').ok
    report = one.transact('add (500 lake "Garda")')
    assert not report.ok and "lake" in str(report.error)
    assert rows(two.db(), "find ?n where (?r river ?n)") == [("Po",)]
    for c in (one, two):
        c.close()
    service.close()


def test_prompt(spark, monkeypatch, capsys):
    monkeypatch.setattr(cli.SparkSession, "builder", type("B", (), {"appName": lambda s, n: s, "config": lambda s, *a: s, "getOrCreate": lambda s: spark})())
    monkeypatch.setattr(sys, "stdin", io.StringIO("test\nfind ?n where (?r river ?n)\nadd (1 nothing 2)\nadd (9 river \"Po\")\nfind\nquit\n"))
    assert cli.main([new_path(spark, "prompt")]) == 0 and cli.main([]) == 2
    said = capsys.readouterr().out
    assert "sample loaded" in said and '"Isar"' in said and "error: no attribute is named nothing" in said and "transaction" in said


def test_compaction_moves_and_sorts_records_once(spark, monkeypatch):
    """One exchange and one sort in each order; tasks by the number of records, none but the last ones of a fact's repeated
    operations is lost, and what is current is told after each."""
    monkeypatch.setattr(stores, "PER_TASK", 4)
    c = Connection(spark, new_path(spark, "sorted"), lambda: CLOCK)
    c.transact(SCHEMA)
    for text in ("add (500 length 1) add (501 length 2)", "add (500 length 1) retract (501 length 2)", "retract (500 length 1) retract (500 length 1)", "add (500 length 1) add (502 length 3)"):
        assert c.transact(text).ok
    text = plan(c.store.merged(c.writing, stores.ORDERS["value"], 3))
    assert text.count("Arguments: rangepartitioning") == 1 and text.count("Exchange\n") == 1 and text.count(") Sort\n") == 1, text
    was = rows(c.db(), "find ?e ?a ?v where (?e ?a ?v)")
    c.compact()
    base = c.store.based(c.writing, {*c.writing.base})
    a = c.db().schema.entity("length")
    assert sorted((r["e"], r["tx"], r["retracted"], r["current"]) for r in base.where(f"a = {a}").collect()) == [(500, 15, False, False), (500, 17, True, False), (500, 18, False, True), (501, 15, False, False), (501, 16, True, False), (502, 18, False, True)]
    assert rows(c.db(), "find ?e ?a ?v where (?e ?a ?v)") == was
    files = {r[0] for r in base.selectExpr("input_file_name()").collect()}
    assert len({f.rsplit("/", 1)[1].split("-")[1] for f in files}) > 2
    assert c.transact("retract (502 length 3)").ok
    c.compact()
    c.close()
    assert rows(c.db(), "find ?e ?v where (?e length ?v)") == [(500, 1)]


def test_frames_are_evaluated_once(spark):
    """What was checked is what is recorded, also if a frame differs from run to run."""
    c = Connection(spark, new_path(spark, "once"))
    c.transact(SCHEMA)
    frame = spark.range(50).selectExpr("id AS e", "'length' AS attribute", "CAST(5 AS TINYINT) AS tag", "CAST(NULL AS STRING) AS s", "CAST(rand() * 1e9 AS BIGINT) AS n", "CAST(NULL AS TIMESTAMP) AS ts")
    assert c.transact_frame(frame).ok
    m = c.store.manifest()
    assert m.log[m.max_tx] == 51 == c.db().record().where(f"tx = {m.max_tx}").count()
    c.close()


def test_bulk_transactions(spark):
    c = Connection(spark, new_path(spark, "bulk"))
    c.transact("{db:ident title db:valueType db:type:string}")
    kind = "e bigint, attribute string, tag tinyint, s string, n bigint, ts timestamp"
    frame = spark.createDataFrame([(i, "title", 0, f"n{i}", None, None) for i in range(5)], kind)
    assert c.transact_frame(frame).ok
    assert c.transact_frame(frame.where("e > 2"), retract=True).ok
    assert rows(c.db(), "find ?e where (?e title ?n)") == [(0,), (1,), (2,)]
    for bad in [(1, "title", 5, None, 3, None), (1, "other", 0, "x", None, None), (1, "title", 0, None, None, None), (None, "title", 0, "x", None, None)]:
        assert not c.transact_frame(spark.createDataFrame([bad], kind)).ok
    assert c.db().record().where("e < 5 and a = 11").count() == 7
    c.close()


def test_new_entities_in_bulk(spark):
    """A word list: an entity for each word."""
    c = Connection(spark, new_path(spark, "words"))
    c.transact("{db:ident word db:valueType db:type:string} {db:ident size db:valueType db:type:long}")
    words = spark.createDataFrame([("a", 1), ("bb", 2), ("ccc", None), ("a", 1)], "w string, n int").repartition(3)
    assert c.insert_frame(words, {"w": "word", "n": "size"}).ok
    got = rows(c.db(), "find ?e ?w where (?e word ?w)")
    assert [e for e, _ in got] == list(range(13, 17)) and sorted(w for _, w in got) == ["a", "a", "bb", "ccc"]
    assert rows(c.db(), "find ?w ?n where (?e word ?w) (?e size ?n)") == [("a", 1), ("a", 1), ("bb", 2)]
    assert c.transact('{word "next"}').new_entities == (19,)
    assert not c.insert_frame(words, {"w": "nothing"}).ok
    c.close()


def test_all_kinds_in_order(spark):
    """Any string < any ident < any ref < … also where kinds are known only by row."""
    values = [string("b"), string("zz"), ident("a"), ref(1), ref(7), Value(Tag.TIMESTAMP, CLOCK), Value(Tag.BOOLEAN, False), Value(Tag.BOOLEAN, True), Value(Tag.LONG, -3), Value(Tag.LONG, 7)]
    names = {Tag.STRING: 20, Tag.IDENT: 21, Tag.REF: 22, Tag.TIMESTAMP: 23, Tag.BOOLEAN: 24, Tag.LONG: 25}
    facts = [datom(i, names[v.tag], v, 5) for i, v in enumerate(values)]
    db = Db.of_datoms(spark.createDataFrame(facts, DATOM))
    got = db.query("find ?x ?y where (?x ?a ?v) (?y ?b ?w) (< ?v ?w)").collect()
    assert sorted((r[0], r[1]) for r in got) == [(i, j) for i, v in enumerate(values) for j, w in enumerate(values) if v < w]
    assert [r[0] for r in db.query("find ?x where (?x ?a 7)").collect()] == [4]
