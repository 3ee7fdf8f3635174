"""Random small databases and queries against nested loops over Python tuples."""

import itertools
import random

import pytest

from asserta.db import Db
from asserta.model import DATOM, Clause, Constraint, Query, Tag, Value, Var, datom, ident, ref, string
from asserta.schema import IDENT, VALUE_TYPE, Schema

NAMES = {"r": (11, Tag.REF), "s": (12, Tag.STRING), "m": (13, Tag.LONG)}
KIND = {Tag.REF: "db:type:ref", Tag.STRING: "db:type:string", Tag.LONG: "db:type:long"}


def definitions():
    out = []
    for name, (a, kind) in NAMES.items():
        out += [datom(a, IDENT, ident(name), 10), datom(a, VALUE_TYPE, ident(KIND[kind]), 10)]
    return out


def value(rng, kind):
    return {Tag.REF: ref(rng.randrange(20, 24)), Tag.STRING: string(rng.choice("xyz")), Tag.LONG: Value(Tag.LONG, rng.randrange(20, 23))}[kind]


def current(operations):
    last = {}
    for e, a, v, tx, retracted in operations:
        key = (e, a, v)
        last[key] = max(last.get(key, (-1, False)), (tx, retracted))
    return [k for k, (_, retracted) in last.items() if not retracted]


def brute(query, facts):
    """None where a variable has values of two kinds by its clauses' attributes, which the engine treats by rule."""
    rows = []
    for chosen in itertools.product(facts, repeat=len(query.clauses)):
        env, good = {}, True
        for clause, (e, a, v) in zip(query.clauses, chosen):
            attribute = clause.attribute if isinstance(clause.attribute, Var) else ref(NAMES[clause.attribute][0])
            wanted = clause.value
            if isinstance(wanted, Value) and isinstance(clause.attribute, str) and NAMES[clause.attribute][1] == Tag.LONG and wanted.tag == Tag.REF:
                wanted = Value(Tag.LONG, wanted.payload)
            for term, got in ((clause.entity if isinstance(clause.entity, Var) else ref(clause.entity), ref(e)), (attribute, ref(a)), (wanted, v)):
                if isinstance(term, Var):
                    good = good and env.setdefault(term.name, got) == got
                else:
                    good = good and term == got
        if not good:
            continue
        for c in query.constraints:
            left, right = (env[t.name] if isinstance(t, Var) else t for t in (c.left, c.right))
            good = good and {"<": left < right, ">": left > right, "not": left != right}[c.op]
        if good:
            rows.append(tuple(env[v.name] for v in query.find))
    return rows


def plain(x, kind):
    if kind is not None:
        return Value(kind, x)
    return Value(Tag(x["tag"]), x["s"] if x["tag"] < 2 else x["n"])


@pytest.mark.parametrize("seed", range(24))
def test_random(spark, seed):
    rng = random.Random(seed)
    operations = []
    for tx in range(20, 34):
        a, kind = rng.choice(list(NAMES.values()))
        operations.append((rng.randrange(20, 24), a, value(rng, kind), tx // 2, rng.random() < 0.25))
    facts = current(operations)
    rows = definitions() + [datom(e, a, v, tx, r) for e, a, v, tx, r in operations]
    schema = Schema.of_rows([(r[0], r[1], r[3], r[6], r[7]) for r in definitions()])
    db = Db.of_datoms(spark.createDataFrame(rows, DATOM), schema)
    for _ in range(3):
        clauses = []
        for _ in range(rng.choice([1, 2, 2, 3])):
            a = rng.choice(["r", "r", "s", "m"])
            # Each kind has its own value variables, so every variable has one kind
            e = Var(rng.choice("ab")) if rng.random() < 0.8 else rng.randrange(20, 24)
            v = {"r": Var(rng.choice("abc")), "s": Var(rng.choice("uv")), "m": Var("w")}[a] if rng.random() < 0.75 else value(rng, NAMES[a][1])
            clauses.append(Clause(e, a, ref(v.payload) if isinstance(v, Value) and v.tag == Tag.LONG else v))
        there = sorted({v.name for c in clauses for v in c.variables()})
        if not there:
            continue
        constraints = []
        for _ in range(rng.choice([0, 1])):
            # Literals of the variable's own kind or of a lower one: numbers against longs would be read as longs
            constraints.append(Constraint(rng.choice(["<", ">", "not"]), Var(rng.choice(there)), rng.choice([Var(rng.choice(there)), string("y")])))
        query = Query(tuple(Var(n) for n in rng.sample(there, len(there))), tuple(clauses), tuple(constraints))
        r = db.relation(query)
        got = [tuple(plain(x, k) for x, k in zip(row, r.kinds.values())) for row in r.frame.collect()]
        assert sorted(got) == sorted(brute(query, facts)), query


def test_free_attributes(spark):
    rng = random.Random(5)
    operations = [(rng.randrange(20, 24), *((a, value(rng, k)) for a, k in [rng.choice(list(NAMES.values()))]).__next__(), 20, False) for _ in range(12)]
    facts = current(operations)
    schema = Schema.of_rows([(r[0], r[1], r[3], r[6], r[7]) for r in definitions()])
    db = Db.of_datoms(spark.createDataFrame([datom(e, a, v, tx, r) for e, a, v, tx, r in operations], DATOM), schema)
    a, x, y, b = (Var(n) for n in "axyb")
    for clauses in ([Clause(x, a, y)], [Clause(x, a, y), Clause(y, b, x)], [Clause(x, a, y), Clause(b, "r", x)], [Clause(20, a, y), Clause(x, "s", y)], [Clause(x, a, x)]):
        names = sorted({v.name for c in clauses for v in c.variables()})
        query = Query(tuple(Var(n) for n in names), tuple(clauses))
        r = db.relation(query)
        got = [tuple(plain(v, k) for v, k in zip(row, r.kinds.values())) for row in r.frame.collect()]
        assert sorted(got) == sorted(brute(query, facts)), clauses


