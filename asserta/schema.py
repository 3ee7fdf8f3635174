"""Attributes are entities with a name (db:ident) and a kind of value (db:valueType); all of it is facts."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from asserta.model import Fact, FactError, Tag, TypeMismatch, UnknownAttribute, Value, datom, ident

#: Entities of the bootstrap transaction, in order of their ids from 0 on (0 is the transaction).
IDENT, TX_TIMESTAMP, VALUE_TYPE, INDEXED = 1, 2, 3, 4
NAMES = ("db:ident", "db:txTimestamp", "db:valueType", "db:indexed", "db:type:ident", "db:type:string", "db:type:timestamp", "db:type:ref", "db:type:boolean")
TYPES = {IDENT: Tag.IDENT, TX_TIMESTAMP: Tag.TIMESTAMP, VALUE_TYPE: Tag.IDENT, INDEXED: Tag.BOOLEAN}
#: `long` has a name here too, so that numbers that aren't entities can be stored from text.
TYPE_NAMES = {f"db:type:{t.name.lower()}": t for t in Tag}
FIRST_ID = len(NAMES) + 1


def bootstrap(now: dt.datetime) -> list[tuple]:
    """The datoms of transaction 0."""
    names = {t: n for n, t in TYPE_NAMES.items()}
    rows = [datom(0, TX_TIMESTAMP, Value(Tag.TIMESTAMP, now), 0)]
    rows += [datom(i + 1, IDENT, ident(n), 0) for i, n in enumerate(NAMES)]
    return rows + [datom(e, VALUE_TYPE, ident(names[t]), 0) for e, t in TYPES.items()]


@dataclass
class Schema:
    """idents: entity by name. types: each attribute's kinds, the latest last; attributes that once had another kind
    may hold values of both."""

    idents: dict[str, int] = field(default_factory=dict)
    types: dict[int, list[Tag]] = field(default_factory=dict)

    @classmethod
    def start(cls) -> Schema:
        return cls({n: i + 1 for i, n in enumerate(NAMES)}, {e: [t] for e, t in TYPES.items()})

    @classmethod
    def of_rows(cls, rows: list[tuple[int, int, str, int, bool]]) -> Schema:
        """From all datoms (e, a, s, tx, retracted) of db:ident and db:valueType, current or not."""
        out = cls()
        for e, a, s, _, retracted in sorted(rows, key=lambda r: (r[3], r[4])):
            out.apply(e, a, ident(s), retracted)
        return out

    def copy(self) -> Schema:
        return Schema(dict(self.idents), {e: list(t) for e, t in self.types.items()})

    def apply(self, e: int, a: int, value: Value, retracted: bool) -> None:
        """What a recorded fact changes. A name goes to the entity that took it last."""
        if a == IDENT:
            if not retracted:
                self.idents[value.payload] = e
            elif self.idents.get(value.payload) == e:
                del self.idents[value.payload]
        elif a == VALUE_TYPE and value.payload in TYPE_NAMES:
            kind, own = TYPE_NAMES[value.payload], self.types.setdefault(e, [])
            if kind in own:
                own.remove(kind)
            own.insert(0 if retracted else len(own), kind)

    def entity(self, name: str) -> int:
        if name not in self.idents:
            raise UnknownAttribute(f"no attribute is named {name}")
        return self.idents[name]

    def kind(self, a: int) -> Tag | None:
        """An attribute's only kind of value, or None where there may be several."""
        own = self.types.get(a, [])
        return own[0] if len(own) == 1 else None

    def checked(self, fact: Fact) -> tuple[int, Value]:
        """The attribute's entity and the value in its kind; a number literal fits ref and long."""
        a = self.entity(fact.attribute)
        if not self.types.get(a):
            raise TypeMismatch(f"{fact.attribute} has no value type")
        kind, value = self.types[a][-1], fact.value
        if kind == Tag.LONG and value.tag == Tag.REF:
            value = Value(Tag.LONG, value.payload)
        if value.tag != kind:
            raise TypeMismatch(f"{fact.attribute} takes a {kind.name.lower()}, not a {value.tag.name.lower()}")
        if a == VALUE_TYPE and value.payload not in TYPE_NAMES:
            raise FactError(f"{value.payload} is no value type")
        return a, value

    def to_json(self) -> dict:
        return {"idents": self.idents, "types": {str(e): [int(t) for t in own] for e, own in self.types.items()}}

    @classmethod
    def from_json(cls, x: dict) -> Schema:
        return cls(dict(x["idents"]), {int(e): [Tag(t) for t in own] for e, own in x["types"].items()})
