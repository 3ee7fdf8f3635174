"""Every registered query of the engine against its SQL, plans of some, and that the operators' package is optional."""

import math
import pathlib
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from asserta import queries as core
from asserta.db import Db
from asserta.model import Tag
from asserta.operators import relational
from asserta.operators.relational import Relation, joined
from asserta.sources.mapping import benchmark_source

DATA = pathlib.Path("/root/testdata/sf0.001")
ROOT = pathlib.Path(__file__).parents[1]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def norm(x):
    return f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else str(x)


@pytest.mark.parametrize("name", core.REGISTRY)
def test_against_sql(spark, duck, name):
    run, sql = core.REGISTRY[name]
    frame = run(spark, str(DATA))
    got = sorted(tuple(norm(r[c]) for c in sorted(frame.columns)) for r in frame.collect())
    there = duck.sql(sql)
    names = there.columns
    assert sorted(names) == sorted(frame.columns)
    assert got == sorted(tuple(norm(x) for _, x in sorted(zip(names, row))) for row in there.fetchall())


def plan(frame):
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_one_scan_with_pushed_filters(spark):
    text = plan(Db(benchmark_source(spark, str(DATA))).query('find ?c ?n where (?c customer:segment "BUILDING") (?c customer:name ?n)'))
    assert text.count("Location:") == 1 and "EqualTo(c_mktsegment,BUILDING)" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in text


def test_joins_are_on_the_tables_own_keys(spark):
    text = plan(Db(benchmark_source(spark, str(DATA))).query("find ?n ?d where (?o orders:customer ?c) (?c customer:name ?n) (?o orders:date ?d)"))
    assert "Join Inner" in text and "Arguments: o_custkey" not in text and "3298534883328" not in text and "6597069766656" not in text


def test_many_rows_joined_with_many_are_dealt_out(spark, monkeypatch):
    """Pairs of one file's rows with another's come from several tasks; all of them, with nulls and several columns."""
    db = Db(benchmark_source(spark, str(DATA)))
    found = db.query("find ?s ?c where (?s supplier:nation ?n) (?c customer:nation ?n)")
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    by_entity = db.query("find ?c ?name where (?c customer:nation ?n) (?n nation:name ?name)")
    assert "posexplode" not in plan(by_entity) and "posexplode" in plan(found)
    monkeypatch.setattr(relational, "BLOCK", 3)
    monkeypatch.setattr(relational, "DEAL", 2)
    left = [(None if i % 11 == 0 else i % 11 % 3, i // 2, None if i % 5 == 0 else f"l{i}") for i in range(60)]
    right = [(i % 4, None if i % 7 == 0 else i // 2) for i in range(50)]
    both = joined(Relation(spark.createDataFrame(left, "k bigint, x bigint, s string"), {"k": Tag.LONG, "x": Tag.LONG, "s": Tag.STRING}), Relation(spark.createDataFrame(right, "k bigint, y bigint"), {"k": Tag.LONG, "y": Tag.LONG}), many=True)
    assert both.frame.columns == ["k", "x", "s", "y"]
    assert sorted(map(str, map(tuple, both.frame.collect()))) == sorted(str((k, x, s, y)) for k, x, s in left for j, y in right if k == j and k is not None)


def test_facts_of_all_attributes_stay_where_they_are(spark):
    """Names of attributes go to the facts; these aren't dealt out by attribute and sorted."""
    for name in ("fetch_full_scan", "fetch_value_only"):
        text = plan(core.REGISTRY[name][0](spark, str(DATA)))
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning" not in text


def test_filters_pass_below_current_facts(spark, tmp_path):
    datoms = core.recorded(spark, str(DATA), 6, lambda d: [])[0]
    path = str(tmp_path / "datoms")
    datoms.write.partitionBy("a").parquet(path)
    source = benchmark_source(spark, str(DATA))
    schema = core.Mapped(spark, (source.tables[6],), source.read).schema
    text = plan(Db.of_datoms(spark.read.parquet(path), schema).query('find ?o where (?o orders:status "F")'))
    assert "PartitionFilters: [isnotnull(a" in text and "EqualTo(s,F)" in text and "HashAggregate" in text and "SortAggregate" not in text


def test_without_the_operators():
    """The entry module imports and lists the engine's queries where the operators' package is missing."""
    code = "import sys; sys.modules['asserta.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; n = set(e.queries()); assert 'dump' in n and 'pipeline' not in n and set(e.oracle_sql()) <= n; print('fine')"
    code = code.replace("sys.modules['asserta.llm'] = None; sys.modules['corpus_pipeline'] = None", "import importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.split('.')[:2] == ['asserta', 'llm'] or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, Gone())")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.stdout.strip() == "fine", out.stderr
