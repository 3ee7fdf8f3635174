"""The algebra over relations: fetch, natural join, product, constrain, project. A relation is a DataFrame with a
column for each variable, and the kind of value of each, None where it varies. A column of entities may hold them less
an offset, so that tables' own keys are joined and filtered as they are: bucketing, runtime filters and pushdown see
plain columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asserta.functions.values import any_value, compared, literal, matches, narrowed, native
from asserta.model import Constraint, Tag, UnboundVariable, Value, Var

#: Rows of a block where many rows are joined with many, and the tasks that gather the rows of one value.
BLOCK, DEAL = 512, 32


@dataclass
class Relation:
    frame: DataFrame
    kinds: dict[str, Tag | None]  # in column order
    offsets: dict[str, int] = field(default_factory=dict)  # a multiple of 2^40; the column's entities lie within 2^40 of it

    def column(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def value(self, name: str) -> Column:
        """The column as values."""
        offset = self.offsets.get(name, 0)
        return self.column(name) + F.lit(offset).cast("bigint") if offset else self.column(name)


def fetched(facts: DataFrame, terms: tuple[Var | int, Var | int, Var | Value], kind: Tag | None) -> Relation:
    """Rows of facts (flat columns) that fit the terms; a column for each variable. Attributes are entities here.
    kind: of the value, if all facts that can fit have one kind. A variable said twice has to be equal."""
    e, a, v = terms
    frame = facts
    for name, term in (("e", e), ("a", a)):
        if not isinstance(term, Var):
            frame = frame.where(F.col(name) == F.lit(term).cast("bigint"))
    columns: dict[str, Column] = {}
    kinds: dict[str, Tag | None] = {}
    for name, term in (("e", e), ("a", a)):
        if isinstance(term, Var):
            if term.name in columns:
                frame = frame.where(F.col("e") == F.col("a"))
            else:
                columns[term.name], kinds[term.name] = F.col(name), Tag.REF
    if isinstance(v, Value):
        frame = frame.where(matches(v))
    elif v.name in columns:
        frame = frame.where((F.col("tag") == int(Tag.REF)) & (F.col("n") == columns[v.name]))
    else:
        if kind is not None:
            frame = frame.where(F.col("tag") == int(kind))
        columns[v.name], kinds[v.name] = (any_value() if kind is None else native(kind)), kind
    return Relation(frame.select(*[c.alias(n) for n, c in columns.items()]), kinds)


def joined(left: Relation, right: Relation, many: bool = False) -> Relation:
    """Natural inner join on all shared variables: left's columns, then right's others. Where a shared variable's kind
    is known on one side only, the other is narrowed to it; kinds known to differ never match. Without shared
    variables it is the product; a relation without variables is a test that the other's rows pass or not.
    many: a value of the shared variables may stand in very many rows of both, so pairs are dealt out."""
    shared = [n for n in left.kinds if n in right.kinds]
    a, b = left.frame, right.frame
    kinds, offsets = dict(left.kinds), {n: o for n, o in right.offsets.items() if n not in left.kinds} | left.offsets
    for n in shared:
        x, y = left.kinds[n], right.kinds[n]
        p, q = left.offsets.get(n, 0), right.offsets.get(n, 0)
        if p and q and p != q:
            a = a.where(F.lit(False))  # entities of different tables
        elif p != q:
            a, b = (a.withColumn(n, left.value(n)), b) if p else (a, b.withColumn(n, right.value(n)))
            offsets.pop(n, None)
        if x == y:
            continue
        if x is None:
            a = a.where(left.column(n)["tag"] == int(y)).withColumn(n, narrowed(left.column(n), y))
            kinds[n] = y
        elif y is None:
            b = b.where(right.column(n)["tag"] == int(x)).withColumn(n, narrowed(right.column(n), x))
        else:
            a = a.where(F.lit(False))
            b = b.withColumn(n, F.lit(None).cast(a.schema[n].dataType))
    new = {n: k for n, k in right.kinds.items() if n not in kinds}
    # A relation without columns has one row or none, as facts are a set: a test, not a product
    if not right.kinds or not left.kinds:
        frame = a.where(b.exists()) if not right.kinds else b.where(a.exists())
    elif many and len(shared) < min(len(left.kinds), len(right.kinds)):
        frame = dealt(a, b, shared)
    else:
        frame = a.join(b, shared, "inner") if shared else a.crossJoin(b)
    return Relation(frame.select(*[F.col(f"`{n}`") for n in [*kinds, *new]]), kinds | new, offsets)


def blocks(frame: DataFrame, shared: list[str], rest: str, number: str) -> DataFrame:
    """A row for each block of at most BLOCK rows with equal values of `shared`: these, the rows' other columns as an
    array, and the block's number, which tells it from the others of these values. What a value has very many rows of is
    gathered in DEAL tasks."""
    others = [n for n in frame.columns if n not in shared]
    keys = [F.col(f"`{n}`") for n in shared]
    row = F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(others)])
    share = F.pmod(F.xxhash64(row), F.lit(DEAL)).alias("share__")
    gathered = frame.groupBy(*keys, share).agg(F.collect_list(row).alias("rows__"))
    # Arrays of a plain column are quicker to unfold than those of structs
    gathered = gathered.select(*keys, "share__", (F.transform("rows__", lambda x: x["c0"]) if len(others) == 1 else F.col("rows__")).alias("rows__"))
    parts = F.transform(F.sequence(F.lit(1), F.size("rows__"), F.lit(BLOCK)), lambda i: F.slice("rows__", i, BLOCK))
    return gathered.select(*keys, "share__", F.posexplode(parts).alias("part__", rest)).select(*keys, rest, (F.col("part__") * DEAL + F.col("share__")).alias(number))


def dealt(left: DataFrame, right: DataFrame, shared: list[str]) -> DataFrame:
    """The natural join by pairs of blocks. They are dealt out by their numbers before they are unfolded, so that work is
    spread by the rows that come out, however few values or files there are, and a task holds one pair at a time."""
    pairs = blocks(left, shared, "left__", "i__").join(blocks(right, shared, "right__", "j__"), shared, "inner")
    keys = [F.col(f"`{n}`") for n in shared]

    def unfolded(frame: DataFrame, rest: str, of: DataFrame, *kept: Column | str) -> DataFrame:
        others = [n for n in of.columns if n not in shared]
        one = frame.select(*keys, *kept, F.explode(rest).alias(rest))
        return one.select(*keys, *kept, *[(F.col(rest) if len(others) == 1 else F.col(rest)[f"c{i}"]).alias(n) for i, n in enumerate(others)])

    # A fixed number, as adaptive execution would size partitions by the arrays, not by what they unfold to
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    half = unfolded(pairs.repartition(tasks, *keys, "i__", "j__"), "left__", left, "right__")
    # Compiled code keeps all rows that one row becomes; coalesce, which moves nothing here, ends it between the two
    return unfolded(half.coalesce(1 << 30), "right__", right, *[F.col(f"`{n}`") for n in left.columns if n not in shared])


def condition(relation: Relation, constraint: Constraint) -> Column:
    """A number literal counts as a long against a variable of longs."""
    for v in constraint.variables():
        if v.name not in relation.kinds:
            raise UnboundVariable(f"?{v.name} of a constraint is in no clause")

    offsets = {relation.offsets.get(v.name, 0) for v in constraint.variables()}
    shift = offsets.pop() if len(offsets) == 1 else 0  # compared less a common offset

    def side(term: Var | Value, other: Var | Value) -> tuple[Column, Tag | None]:
        if isinstance(term, Var):
            return (relation.column if shift else relation.value)(term.name), relation.kinds[term.name]
        if term.tag == Tag.REF and isinstance(other, Var) and relation.kinds[other.name] == Tag.LONG:
            term = Value(Tag.LONG, term.payload)
        return literal(Value(Tag.REF, term.payload - shift) if shift and term.tag == Tag.REF else term), term.tag

    return compared(constraint.op, *side(constraint.left, constraint.right), *side(constraint.right, constraint.left))


def constrained(relation: Relation, constraints: list[Constraint]) -> Relation:
    frame = relation.frame
    for c in constraints:
        frame = frame.where(condition(relation, c))
    return Relation(frame, relation.kinds, relation.offsets)


def projected(relation: Relation, find: tuple[Var, ...]) -> Relation:
    """The variables asked for in that order, said twice or not; rows stay a bag."""
    for v in find:
        if v.name not in relation.kinds:
            raise UnboundVariable(f"?{v.name} is in no clause")
    return Relation(relation.frame.select(*[relation.value(v.name).alias(v.name) for v in find]), {v.name: relation.kinds[v.name] for v in find})
