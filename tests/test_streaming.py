import pytest

from asserta.db import Connection
from asserta.sources.workspace import new_path
from asserta.streaming.tail import changes, follow, stream


def test_follow(spark, tmp_path):
    c = Connection(spark, new_path(spark, "stream"))
    c.transact("{db:ident name db:valueType db:type:string}")
    c.transact('add (1 name "x") add (2 name "y")')
    seen = []
    follow(c.store, lambda rows, _: seen.extend((r["e"], r["s"], r["retracted"]) for r in rows.where("a = 11").collect()), str(tmp_path / "c"), once=True).awaitTermination()
    assert sorted(seen) == [(1, "x", False), (2, "y", False)]
    seen.clear()
    c.transact('retract (1 name "x")')
    # A log without a manifest entry is no transaction
    spark.createDataFrame([(9, 11, 0, "lost", None, None, False)], "e bigint, a bigint, tag tinyint, s string, n bigint, ts timestamp, retracted boolean").write.parquet(f"{c.store.path}/txlog/tx=999")
    follow(c.store, lambda rows, _: seen.extend((r["e"], r["s"], r["retracted"]) for r in rows.where("a = 11").collect()), str(tmp_path / "c"), once=True, patience=0.5).awaitTermination()
    assert seen == [(1, "x", True)]
    c.close()


def test_a_failed_transaction_is_never_followed(spark, tmp_path, monkeypatch):
    """Nor lost, if it is committed later than its log was seen."""
    c = Connection(spark, new_path(spark, "ghosts"))
    c.transact("{db:ident name db:valueType db:type:string}")
    seen, where = [], str(tmp_path / "c")
    run = lambda: follow(c.store, lambda rows, _: seen.extend(r["s"] for r in rows.where("a = 11").collect()), where, once=True, patience=0.2).awaitTermination()
    publish = c.store.publish
    monkeypatch.setattr(c.store, "publish", lambda m: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        c.transact('add (1 name "ghost")')
    run()
    monkeypatch.setattr(c.store, "publish", publish)
    assert c.transact('add (1 name "real")').ok
    run()
    assert seen == ["real"] and [r["n"] for r in c.db().query("find ?n where (?e name ?n)").collect()] == ["real"]
    # The log is there before the manifest names it
    held = []
    monkeypatch.setattr(c.store, "publish", lambda m: (run(), held.extend(seen), publish(m)))
    c.transact('add (2 name "late")')
    assert held == ["real"]
    run()
    assert seen == ["real", "late"]
    # A writer that went away in the middle
    lost = c.writing.next_id
    spark.createDataFrame([(9, 11, 0, "lost", None, None, False)], "e bigint, a bigint, tag tinyint, s string, n bigint, ts timestamp, retracted boolean").write.parquet(f"{c.store.path}/txlog/tx={lost}")
    c.close()
    run()
    other = Connection(spark, c.store.path)
    assert other.transact('add (3 name "next")').tx > lost
    run()
    assert seen == ["real", "late", "next"]
    other.close()


def test_changes(spark, tmp_path):
    c = Connection(spark, new_path(spark, "changes"))
    c.transact("{db:ident name db:valueType db:type:string}")
    c.transact('add (1 name "x") add (2 name "y")')
    c.transact('retract (1 name "x")')
    q = changes(stream(spark, c.store.path)).writeStream.format("memory").queryName("changed").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["e"], r["current"]) for r in spark.table("changed").where("a = 11").collect()} == {(1, False), (2, True)}
    c.close()
