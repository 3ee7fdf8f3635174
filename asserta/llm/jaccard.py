"""N-gram Jaccard join by chosen paths.

A text's set holds the hashes of its windows of GRAM words (white space separates words; A-Z are lower-cased); a text
of fewer words has one window of all of them. Texts with the same set are one representative. Each representative is
embedded as SIGNS minimal hashes. A run of the chosen-path tree splits a bucket on sampled coordinates: each is taken
with probability 1 / (SIMILAR * SIGNS), by a hash of the bucket, so two sets that are SIMILAR share about one of the
sub-buckets at every level. Buckets of up to SMALL are compared in full by their signs; larger ones are compared with a few
of their members. Where these show that the bucket is one component but for SMALL members at most, the latter are compared
with all; other large buckets are split again, up to DEPTH levels; what is still larger then is taken as alike. Runs are repeated until a pair of similarity SIMILAR is missed with probability
1 - RECALL at most, even at the last level.

Buckets give candidate links as stars, never pairs, and components of candidates are verified: the sets of a component
are compared exactly, in blocks of about BLOCK sets or ITEMS hashes, each pair of blocks in a group of its own, so no
task's input grows with a group's size and nothing is written for a pair. In a component of several blocks only sets
whose sizes can be similar meet: sizes fall in classes a factor 1 / SIMILAR wide, and blocks of one class or of
neighbours are compared. A class is a component of verified links; a text's number of links counts the other texts,
copies too, at SIMILAR or more. Links within a candidate component are all found.

Edge cases: null and empty texts, and those of white space alone, have no set: each is a class of its own without
links. Rows have numbers of their own from the first write on, so null and repeated ids are safe; a class's id is its
least doc_id (null if it has none), and its keeper the row with it, the first of several. Repeated rows are copies of
each other. Columns asked for are carried, whatever their names, but for the names this module makes."""

from __future__ import annotations

import functools
import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asserta.llm._common import MOST_BITS, bloom_bits, bloom_has, chunks, one_thread, with_text, written
from asserta.llm.textvec import mix, windows, words

GRAM, SIMILAR = 5, 0.8
SIGNS, SMALL, DEPTH, RECALL = 64, 512, 4, 0.999
PIVOTS = 4  # members that a large bucket is compared with
LEAST = 37  # equal signs of SIGNS for a candidate: at SIMILAR, fewer occur about once in 100 000
BLOCK, ITEMS = 512, 1 << 21
_RNG = np.random.Generator(np.random.PCG64(2018))
_XOR, _TIMES = _RNG.integers(0, 1 << 63, SIGNS, dtype=np.uint64), _RNG.integers(0, 1 << 63, SIGNS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = mix(np.arange(1, SIGNS + 1, dtype=np.uint64))
_TAKEN = np.uint64(int(2.0**64 / (SIMILAR * SIGNS)))


def runs_needed() -> int:
    """A pair of similarity SIMILAR shares a sub-bucket of a coordinate with probability 1 / SIGNS, at each level."""
    alive = 1.0
    for _ in range(DEPTH):
        alive = 1 - (1 - alive / SIGNS) ** SIGNS
    return math.ceil(math.log(1 - RECALL) / math.log(1 - alive))


def _roots() -> list[tuple[int, np.uint64]]:
    """(coordinate, salt) of the first level's splits of all runs."""
    out = []
    for run in range(runs_needed()):
        h = mix(_SALT ^ mix(np.array([run + 1000], np.uint64)))
        out += [(int(i), mix(h[i : i + 1] + np.uint64(run))[0]) for i in np.flatnonzero(h < _TAKEN)]
    return out


def sets(texts: pa.LargeStringArray) -> list[np.ndarray]:
    """Each text's set, ascending."""
    w = words(texts)
    h, first = windows(w.hash, w.first, GRAM)
    return [np.unique(h[a:b]) for a, b in zip(first, first[1:])]


def _hashes() -> list[Column]:
    """128 bits that stand for a text."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def sketch(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, two hashes of the text, and of its set the digest (k1, k2), size, signs and first buckets."""
    kept = [F.col(f"`{c}`") for c in keep]
    new = [T.StructField(n, t) for n, t in (("h1", T.LongType()), ("h2", T.LongType()), ("k1", T.LongType()), ("k2", T.LongType()), ("size", T.LongType()), ("signs", T.BinaryType()), ("buckets", T.ArrayType(T.LongType())))]
    schema = T.StructType(docs.select(*kept).schema.fields + new)
    inputs, text_at = with_text(docs.withColumns(dict(zip(("h1_read", "h2_read"), _hashes()))), [*keep, "h1_read", "h2_read"])
    roots = _roots()
    at, salt = np.array([i for i, _ in roots]), np.array([s for _, s in roots], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, piece in chunks(batch.column(text_at)):
                own = sets(piece)
                full = [d for d, s in enumerate(own) if len(s)]
                keys = np.zeros((len(full), 2), np.int64)
                signs = np.zeros((len(full), SIGNS), np.uint64)
                if full:
                    flat = np.concatenate([own[d] for d in full])
                    first = np.cumsum([0, *(len(own[d]) for d in full[:-1])])
                    keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(own[d].tobytes()), np.int64) for d in full])
                    for i in range(SIGNS):
                        signs[:, i] = np.minimum.reduceat((flat ^ _XOR[i]) * _TIMES[i], first)
                short = (mix(signs) >> np.uint64(48)).astype(np.uint16)
                buckets = mix(signs[:, at] ^ salt).view(np.int64)
                place = {d: k for k, d in enumerate(full)}
                rows = [place.get(d) for d in range(len(piece))]
                made = [
                    *(batch.column(len(keep) + j).slice(start, len(piece)) for j in (0, 1)),
                    *(pa.array([None if k is None else int(keys[k, j]) for k in rows], pa.int64()) for j in (0, 1)),
                    pa.array([len(x) for x in own], pa.int64()),
                    pa.array([None if k is None else short[k].tobytes() for k in rows], pa.binary()),
                    pa.array([None if k is None else buckets[k] for k in rows], pa.list_(pa.int64())),
                ]
                rest = [batch.column(i).slice(start, len(piece)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*rest, *made], names=[*keep, *(f.name for f in new)])

    return inputs.mapInArrow(run, schema)


def by_group(batches: Iterator[pa.RecordBatch], keys: int, most: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come sorted by their first `keys` columns, cut so that groups stay whole: (rows, where the groups
    begin and the last ends)."""
    held: pa.Table | None = None

    def edges(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for i in range(keys):
            x = t.column(i).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = pa.Table.from_batches([batch.slice(at, most)])
            held = pa.concat_tables([held, part]) if held is not None else part
            edge = edges(held)
            if len(edge) > 2:
                yield held.slice(0, edge[-2]), edge[:-1]
                held = held.slice(edge[-2])
    if held is not None and held.num_rows:
        yield held, edges(held)


def _least_label(linked: np.ndarray) -> np.ndarray:
    """The least index of each index's component, by search from each one not reached yet."""
    n = len(linked)
    label = np.full(n, -1)
    for k in range(n):
        front = np.array([k] if label[k] < 0 else [], np.int64)
        while len(front):
            label[front] = k
            front = np.flatnonzero(linked[front].any(0) & (label < 0))
    return label


def split(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (bucket, rep, label, signs) to rows (bucket, rep, label) of the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                bucket = batch.column(0).to_numpy().view(np.uint64)
                signs = _signs(batch.column(3))
                h = mix(bucket[:, None] ^ _SALT ^ np.uint64(level << 32))
                row, i = np.nonzero(h < _TAKEN)
                new = mix(h[row, i] * np.uint64(2) + np.uint64(1) ^ (signs[row, i].astype(np.uint64) << np.uint64(20)))
                yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), *(batch.column(k).take(pa.array(row)) for k in (1, 2))], names=["bucket", "rep", "label"])

    return run


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SIGNS)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, signs, pivot, the pivot's signs): those that are candidates, as edges (a, b), a > b."""
    for whole in batches:
        for at in range(0, whole.num_rows, 8192):
            batch = whole.slice(at, 8192)
            rep, pivot = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            hit = ((_signs(batch.column(1)) == _signs(batch.column(3))).sum(1) >= LEAST) & (rep != pivot)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(rep, pivot)[hit]), pa.array(np.minimum(rep, pivot)[hit])], names=["a", "b"])


def _alike(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Which rows of signs of s and t are candidates, some rows at a time."""
    out = np.empty((len(s), len(t)), bool)
    for at in range(0, len(s), 32):
        out[at : at + 32] = np.count_nonzero(s[at : at + 32, None, :] == t[None, :, :], axis=2) >= LEAST
    return out


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, rep, signs), sorted by bucket: a star for each component of a bucket's candidates."""
    for rows, edge in by_group(batches, 1):
        rep = rows.column(1).to_numpy()
        signs = _signs(rows.column(2))
        size = np.diff(edge)
        two = edge[:-1][size == 2]
        two = two[(signs[two] == signs[two + 1]).sum(1) >= LEAST]
        a, b = [np.maximum(rep[two], rep[two + 1])], [np.minimum(rep[two], rep[two + 1])]
        for k in np.flatnonzero(size > 2):
            x, y = edge[k], edge[k + 1]
            order = np.argsort(rep[x:y])
            s, r = signs[x:y][order], rep[x:y][order]
            label = _least_label(_alike(s, s))
            other = label != np.arange(len(label))
            a.append(r[other])
            b.append(r[label[other]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["a", "b"])


def compare_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, block, rep, the bucket's most frequent label, whether the row has another, signs), sorted by bucket
    and block: an edge to that label for each row that has another and meets one that has it; and, once for a bucket,
    stars of the rows that have others."""
    for rows, edge in by_group(batches, 2):
        block, rep, most = (rows.column(i).to_numpy() for i in (1, 2, 3))
        other = np.array(rows.column(4).to_pylist(), bool)
        signs = _signs(rows.column(5))
        a, b = [], []
        for x, y in zip(edge, edge[1:]):
            few, rest = x + np.flatnonzero(other[x:y]), x + np.flatnonzero(~other[x:y])
            few = few[np.argsort(rep[few])]
            if block[x] == 0:
                label = _least_label(_alike(signs[few], signs[few]))
                moved = label != np.arange(len(label))
                a.append(rep[few[moved]])
                b.append(rep[few[label[moved]]])
            met = few[_alike(signs[few], signs[rest]).any(1)]
            a.append(np.maximum(rep[met], most[met]))
            b.append(np.minimum(rep[met], most[met]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["a", "b"])


def nearly_one(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets of rows (bucket, rep, label) that need no split: (bucket, n, most frequent label) where SMALL rows at
    most, but some, have another label; and all those, with the buckets of one label too."""
    tally = large.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    top = tally.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"))
    done = written(top.where(F.col("n") - F.col("top.n") <= SMALL).select("bucket", "n", F.col("top.label").alias("most"), (F.col("n") - F.col("top.n")).alias("others")), "done")
    return done.where("others > 0").drop("others"), done.select("bucket")


def in_blocks(large: DataFrame, few: DataFrame) -> DataFrame:
    """Rows (bucket, block, rep, most, other) of the buckets `few`: those of the most frequent label are dealt out in
    blocks, those of others are in each, at most a fourth as many rows more."""
    rows = large.join(few, "bucket").withColumn("other", F.col("label") != F.col("most"))
    blocks = F.ceil(F.col("n") / (4 * SMALL))
    block = F.when(F.col("other"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), blocks)))
    return rows.select("bucket", F.explode(block).alias("block"), "rep", "most", "other")


def candidates(reps: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, over representatives that may be similar. reps: rep, signs, buckets.

    Each large bucket of the first level is compared with PIVOTS of its members. What meets pivots makes components;
    each representative has the label of its own. Only pairs of different labels are left to find. So a bucket whose
    members have one label goes no further, and one in which at most SMALL members have another label than the most
    frequent is compared now, these members with all: a group of near copies is not carried from level to level."""
    signs = reps.select("rep", "signs")
    rows = reps.select("rep", F.col("rep").alias("label"), F.explode("buckets").alias("bucket"))
    small, blocks, edges = [], [], []
    for level in range(1, DEPTH + 1):
        pivots = [F.min_by("rep", F.xxhash64(F.lit(k), "rep")).alias(f"p{k}") for k in range(PIVOTS)]
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("count"), F.min("label").alias("x"), F.max("label").alias("y"), *pivots)
        sizes = written(sizes.where("x < y").drop("x", "y"), f"sizes{level}")
        shared = written(rows.join(sizes.select("bucket", "count"), "bucket"), f"level{level}")
        small.append(shared.where(F.col("count") <= SMALL).select("bucket", "rep"))
        large, hot = shared.where(F.col("count") > SMALL).select("bucket", "rep", "label"), sizes.where(F.col("count") > SMALL)
        if hot.isEmpty():
            break
        if level == 1:
            each = hot.select("bucket", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("pivot"))
            each = each.join(signs.toDF("pivot", "pivot_signs"), "pivot")
            met = written(large.join(signs, "rep").join(each, "bucket").select("rep", "signs", "pivot", "pivot_signs").mapInArrow(meet, "a long, b long").distinct(), "met")
            edges.append(met)
            label = components(met).toDF("rep", "least")
            large = written(large.join(label, "rep", "left").select("bucket", "rep", F.coalesce("least", "label").alias("label")), "large")
        few, done = nearly_one(large)
        blocks.append(in_blocks(large, few))
        large, hot = large.join(done, "bucket", "left_anti"), hot.join(done, "bucket", "left_anti")
        if hot.isEmpty():
            break
        if level == DEPTH:
            stars = large.join(hot.select("bucket", F.col("p0").alias("b")), "bucket").where("rep != b")
            edges.append(stars.select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")))
            break
        rows = large.join(signs, "rep").select("bucket", "rep", "label", "signs").mapInArrow(split(level), "bucket long, rep long, label long")
        rows = written(rows.distinct(), f"split{level}")
    both = functools.reduce(DataFrame.unionAll, small)
    signed = both.join(signs, "rep").select("bucket", "rep", "signs")
    out = signed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, "a long, b long")
    if blocks:
        signed = functools.reduce(DataFrame.unionAll, blocks).join(signs, "rep").select("bucket", "block", "rep", "most", "other", "signs")
        out = out.unionAll(signed.repartition("bucket", "block").sortWithinPartitions("bucket", "block").mapInArrow(compare_few, "a long, b long"))
    for more in edges:
        out = out.unionAll(more)
    return out.distinct()


def _least(edges: DataFrame) -> DataFrame:
    """Each a's least b. `a` is computed anew, so a join by it deals these rows out again, and adaptive execution may
    split the edges of a node that has very many."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").bitwiseXOR(F.lit(0)).alias("a"), "m")


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node but a component's least with that one. Alternates large and small stars until nothing
    changes; edges (a, b) have a > b."""
    edges = written(edges, "edges")
    sign = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == sign or not now[0]:
            return edges
        sign = now
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = _least(large)
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "edges")


def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, rep, own block, copies, k1, k2, blocks to meet, text): the set in place of the text, which has
    to be the one that the digest tells."""
    for batch in batches:
        for start, piece in chunks(batch.column(7)):
            own = [x.tobytes() for x in sets(piece)]
            for x, p, q in zip(own, *(batch.column(i).slice(start, len(piece)).to_pylist() for i in (4, 5))):
                if struct.unpack("<qq", xxhash.xxh3_128_digest(x)) != (p, q):
                    raise ValueError("two texts have the same 128 bits of hash")
            rest = [batch.column(i).slice(start, len(piece)) for i in (0, 1, 2, 3, 6)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(own, pa.binary())], names=["component", "rep", "own", "copies", "others", "items"])


def exact(rows: pa.Table, edge: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of rows (component, block, block, rep, own block, copies, set): reps, the least rep of each one's
    verified component within the group, and its number of linked texts. Of a pair of different blocks only links
    between the two count."""
    for x, y in zip(edge, edge[1:]):
        group = rows.slice(x, y - x)
        first, second = group.column(1)[0].as_py(), group.column(2)[0].as_py()
        rep, block, copies = (group.column(i).to_numpy() for i in range(3, 6))
        own = [np.frombuffer(b, np.uint64) for b in group.column(6).to_pylist()]
        order = np.argsort(rep)
        if len(order) < 2:
            continue
        rep, block, copies, own = rep[order], block[order], copies[order], [own[i] for i in order]
        n = len(own)
        size = np.array([len(s) for s in own])
        if n == 2:
            common = np.zeros((2, 2))
            common[0, 1] = common[1, 0] = len(np.intersect1d(own[0], own[1], assume_unique=True))
        else:
            value, column, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(n), size)
            again = times[column] > 1
            row, column = row[again], (np.cumsum(times > 1) - 1)[column[again]]
            by = np.argsort(column, kind="stable")
            row, column = row[by], column[by]
            common = np.zeros((n, n), np.float32)
            width = max(256, (1 << 23) // n)
            for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
                a, b = np.searchsorted(column, [at, at + width])
                has = np.zeros((n, width), np.float32)
                has[row[a:b], column[a:b] - at] = 1
                common += has @ has.T
        # common / union >= 4 / 5
        linked = 5 * common >= 4 * (size[:, None] + size[None, :] - common)
        np.fill_diagonal(linked, False)
        if first != second:
            linked &= block[:, None] != block[None, :]
        yield rep, rep[_least_label(linked)], (linked * copies[None, :]).sum(1)


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one_thread()
    for rows, edge in by_group(batches, 3, 256):
        found = list(exact(rows, edge))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)], names=["rep", "root", "links"])


def near_duplicates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, class_id, n_links, and keeper: whether the row is its class's first. docs has doc_id and
    text."""
    base = written(sketch(docs.withColumn("id__", F.col("doc_id")), [*keep, "id__"]).withColumn("row", F.monotonically_increasing_id()), "sketches")
    order = F.struct(F.col("id__").isNull().alias("none"), "id__", "row")
    reps = base.where(F.col("k1").isNotNull()).groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min(order).alias("least"), F.first("signs").alias("signs"), F.first("buckets").alias("buckets"), F.first("size").alias("size"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    stars = components(candidates(reps))
    member = stars.unionAll(stars.select(F.col("b").alias("a"), "b").distinct()).select(F.col("a").alias("rep"), F.col("b").alias("component"))
    kind = F.floor(F.log(F.col("size")) / math.log(1 / SIMILAR)).cast("long").alias("kind")
    member = written(member.join(reps.select("rep", "k1", "k2", "copies", "h1", "h2", "size"), "rep").withColumn("kind", kind), "members")
    # Of each component, how many blocks each class of sizes has
    kinds = member.groupBy("component", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("items"))
    many = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("items") / ITEMS)).alias("blocks")
    kinds = kinds.groupBy("component").agg(((F.sum("n") <= BLOCK) & (F.sum("items") <= ITEMS)).alias("one"), F.map_from_entries(F.collect_list(F.struct("kind", many))).alias("blocks"))
    n = member.count()
    member = member.join(written(kinds, "kinds"), "component")
    # Only texts of members move: a Bloom filter of bounded size leaves the others where they are
    hashes = member.select("h1").distinct()
    size = min(MOST_BITS, max(64, -(-n * 10 // 64) * 64))
    bits = written(bloom_bits(hashes, "h1", 9, size, 5), "bits")
    some = docs.select(*(h.alias(n) for h, n in zip(_hashes(), ("h1", "h2"))), F.col("text").alias("text_read"))
    some = some.where(bloom_has(bits.scalar(), F.col("h1"), 9, size, 5)).dropDuplicates(["h1", "h2"])

    def block(kind: Column, number: Column) -> Column:
        return F.shiftleft(kind, 32) + number

    def of_kind(kind: Column) -> Column:
        n = F.coalesce(F.element_at("blocks", kind), F.lit(0).cast("long"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: block(kind, k))).otherwise(F.array().cast("array<long>"))

    none = F.lit(0).cast("long")
    own = F.when(F.col("one"), none).otherwise(block(F.col("kind"), F.pmod(F.xxhash64("rep"), F.element_at("blocks", F.col("kind")))))
    others = F.when(F.col("one"), F.array(none)).otherwise(F.concat(*[of_kind(F.col("kind") + k) for k in (-1, 0, 1)]))
    dealt = member.join(some, ["h1", "h2"]).select("component", "rep", own.alias("own"), "copies", "k1", "k2", others.alias("others"), "text_read")
    dealt = dealt.mapInArrow(unfold, "component long, rep long, own long, copies long, others array<long>, items binary").withColumn("other", F.explode("others"))
    pairs = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "own", "copies", "items")
    checked = written(pairs.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(verify, "rep long, root long, links long"), "verified")
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    # Over the blocks of a component the parts' roots are edges again; of one block they are stars already
    roots = components(checked.where("root < rep").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    classed = reps.select("rep", "k1", "k2", "copies", "least").join(roots.withColumnRenamed("a", "rep"), "rep", "left").join(links, "rep", "left")
    classed = classed.withColumn("root", F.coalesce("b", "rep"))
    first = classed.groupBy("root").agg(F.min("least").alias("first"))
    classed = classed.join(first, "root").select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "first")
    base = base.drop("signs", "buckets", "h1", "h2", "size")
    found = base.where(F.col("k1").isNotNull()).join(classed, ["k1", "k2"])
    ids = [F.col(f"`{c}`") for c in keep]
    alone = base.where(F.col("k1").isNull()).select(*ids, F.col("id__").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("keeper"))
    return found.select(*ids, F.col("first.id__").alias("class_id"), "n_links", (F.col("first.row") == F.col("row")).alias("keeper")).unionAll(alone)


#: The query over `documents` in DuckDB: every pair of different sets that share a window is compared.
SQL = r"""
WITH RECURSIVE split AS (
    SELECT row_number() OVER () AS r, doc_id, [w FOR w IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS w FROM documents
), sets AS (
    SELECT r, doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS s FROM split WHERE len(w) > 0
), reps AS (
    SELECT row_number() OVER () AS rep, s, count(*) AS copies, min(doc_id) AS least FROM sets GROUP BY s
), items AS (SELECT rep, len(s) AS n, unnest(s) AS item FROM reps),
links AS (
    SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.item = b.item AND a.rep <> b.rep
    GROUP BY a.rep, b.rep, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))
), reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
class AS (SELECT a AS rep, min(least) AS class_id FROM reach JOIN reps ON rep = b GROUP BY a),
linked AS (SELECT a AS rep, sum(copies) AS n FROM links JOIN reps ON rep = b GROUP BY a)
SELECT doc_id, class_id, CAST(copies - 1 + coalesce(n, 0) AS BIGINT) AS n_links FROM sets JOIN reps USING (s) JOIN class USING (rep) LEFT JOIN linked USING (rep)
UNION ALL SELECT doc_id, doc_id, 0 FROM split WHERE len(w) = 0
"""
