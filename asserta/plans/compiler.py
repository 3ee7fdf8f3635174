"""Bound patterns to one lazy DataFrame; Catalyst and adaptive execution choose how it runs."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asserta.model import Query, Value, Var
from asserta.operators.relational import Relation, constrained, fetched, joined, projected
from asserta.plans.binder import Pattern, bound, ordered
from asserta.schema import IDENT, VALUE_TYPE, Schema


class Source(Protocol):
    schema: Schema

    def facts(self, entity: int | None, attribute: int | None, value: Value | None) -> DataFrame:
        """Current facts in flat columns, at least those that fit what is given."""

    def group(self, p: Pattern) -> object | None:
        """Patterns of one entity and one group are answered by one scan; None: on its own."""

    def star(self, patterns: list[Pattern]) -> Relation:
        """The relation of patterns of one entity and group."""


def fetch(source: Source, p: Pattern) -> Relation:
    """What defines attributes is as small as the schema, so it is sent to the facts it is joined with: those stay where
    they are, in place of being dealt out by their few attributes and sorted."""
    given = [None if isinstance(t, Var) else t for t in (p.entity, p.attribute, p.value)]
    found = fetched(source.facts(*given), (p.entity, p.attribute, p.value), p.kind)
    return Relation(F.broadcast(found.frame), found.kinds, found.offsets) if p.attribute in (IDENT, VALUE_TYPE) else found


def compiled(query: Query, source: Source) -> Relation:
    groups: dict[object, list[Pattern]] = {}
    for k, p in enumerate(bound(query, source.schema)):
        group = source.group(p)
        groups.setdefault((p.entity, group) if group is not None else k, []).append(p)
    units = list(groups.items())
    whole, entities = None, set()
    for i in ordered([(set().union(*(p.variables() for p in own)), sum(p.constants() for p in own)) for _, own in units]):
        key, own = units[i]
        part = source.star(own) if isinstance(key, tuple) else fetch(source, own[0])
        # Of what is an entity on neither side, each value may have very many rows on both
        own_entities = {p.entity.name for p in own if isinstance(p.entity, Var)}
        shared = {n for n in part.kinds if whole is not None and n in whole.kinds}
        whole = part if whole is None else joined(whole, part, len(shared) == 1 and not shared & (entities | own_entities))
        entities |= own_entities
    return projected(constrained(whole, list(query.constraints)), query.find)
