"""Benchmark decontamination by template canonicalisation.

A text becomes a template: its words (runs of ASCII letters and digits and of bytes from 0x80 on; a point or comma
between digits belongs to its number) are lower-cased, and typed placeholders stand for numbers (words that begin
with a digit), units (a listed unit after a number) and names (a word of two letters or more with a capital that
doesn't begin a sentence). Windows of WINDOW template words of the benchmark form a hash table; a text's windows probe it. Windows
that meet along one diagonal form an aligned run. A run is a leak if it spans RUN words, or the whole item where that
is shorter, and its slots are consistent: equal values of the item always stand against equal values of the text, and
the other way round. So a question with other numbers or names is found (``reparameterised``), one that mixes them up
isn't, and equal wording is ``exact``.

What the templates miss is looked for word by word: windows of the case-folded words themselves (Unicode, no
placeholders) give the longest equal run, which is ``exact`` if it is as long. So a copy in capitals is found, where
templates take words for names, and so are the equal stretches of a copy whose run has slots that don't agree. Where
templates find an item in a text, theirs is the run told. Items too short for a template, or of nearly nothing but
numbers and names, are found this way only; those of nothing but numbers aren't looked for.

The benchmark's different texts are hashed in blocks of about BLOCK characters, each a file in the shared folder. The
texts are scanned once and never shuffled: a task reads up to HELD bytes of them and joins their windows with one block
after the other, so what it holds is bounded however long the benchmark is. Items of equal text are one in the blocks;
the least of their ids stands for them there, and `leaked` adds the others by a join.

Edge cases: null and empty texts or items have no template and never match; a template needs LITERAL words that aren't
placeholders, as does each of its windows, so that shapes alone never match. Rows are independent; ties don't arise. Repeated
rows are judged alike. Extra columns are carried through, whatever their names; only the new column's name is taken."""

from __future__ import annotations

import functools
import os
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asserta.llm._common import chunks, with_text, written
from asserta.llm.textvec import hash_spans, mix, raw, runs, windows
from asserta.sources.workspace import new_path, put_file

WINDOW = 8
RUN = 10
LITERAL = 4
BLOCK, HELD = 1 << 24, 1 << 26
#: The units known.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years km/h mph kph m/s hz khz mhz ghz v w kw kwh j kj cal kcal k c f degree degrees percent usd eur gbp dollar dollars euro euros pound pounds cent cents meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms mile miles inch inches foot feet".split()
LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("words", T.IntegerType()), T.StructField("share", T.DoubleType()), T.StructField("kind", T.StringType())]))

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_CORE = _DIGIT | _UPPER
_CORE[97:123] = True
_CORE[128:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:\n")] = True
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x6E756D626572A5A5, 0x6E616D65A5A5A5A5, 0x756E6974A5A5A5A5))


class Template(NamedTuple):
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # the number of each text's first word, and the count of all
    hash: np.ndarray  # of each word, or the placeholder's
    slot: np.ndarray  # whether it is a placeholder

    def value(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes().lower()


def _unit_hashes() -> np.ndarray:
    joined = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    start, end = runs(joined != 32, np.array([0, len(joined)]))
    return np.sort(hash_spans(joined, start, end))


_UNITS = _unit_hashes()


def folded(texts: pa.LargeStringArray) -> Template:
    """The case-folded words, without placeholders. texts has no nulls."""
    data, at = raw(pa.array([t.casefold() for t in texts.to_pylist()], pa.large_string()))
    start, end = runs(_cores(data), at)
    return Template(data, start, end, np.searchsorted(start, at), hash_spans(data, start, end), np.zeros(len(start), bool))


def _cores(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    core = _CORE[data]
    if len(data) > 2:
        core[1:-1] |= ((data[1:-1] == 46) | (data[1:-1] == 44)) & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
    return core


def template(texts: pa.LargeStringArray) -> Template:
    """texts has no nulls."""
    data, at = raw(texts)
    start, end = runs(_cores(data), at)
    first = np.searchsorted(start, at)
    hashed = hash_spans(data, start, end)
    if not len(start):
        return Template(data, start, end, first, hashed, np.zeros(0, bool))
    lead = data[start]
    number = _DIGIT[lead]
    after_number = np.concatenate([[False], number[:-1]])
    after_number[first[:-1][first[:-1] < len(start)]] = False
    place = np.minimum(np.searchsorted(_UNITS, hashed[after_number]), len(_UNITS) - 1)
    unit = np.zeros(len(start), bool)
    unit[np.flatnonzero(after_number)[_UNITS[place] == hashed[after_number]]] = True
    stops = np.concatenate([[0], np.cumsum(_STOP[data], dtype=np.int32)])
    opens = np.concatenate([[True], stops[start[1:]] != stops[end[:-1]]])
    opens[first[:-1][first[:-1] < len(start)]] = True
    name = _UPPER[lead] & ~opens & (end - start > 1) & ~unit
    hashed = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, hashed)))
    return Template(data, start, end, first, hashed, number | unit | name)


def _sized(t: Template, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window of `size` words in one text with enough literal words."""
    n = len(t.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed, first = windows(t.hash, t.first, size)
    counts = np.diff(t.first)
    full = np.repeat(counts >= size, np.diff(first))
    word = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first)) + np.repeat(t.first[:-1], np.diff(first))
    hashed, word = hashed[full], word[full]
    literal = np.concatenate([[0], np.cumsum(~t.slot, dtype=np.int32)])
    rich = literal[word + size] - literal[word] >= min(LITERAL, size)
    return hashed[rich] ^ mix(np.array([size], np.uint64))[0], word[rich]


class Table:
    """The windows of items. Items shorter than WINDOW have one window of their own length; those not `able`, none."""

    def __init__(self, items: Template, able: np.ndarray):
        length = np.diff(items.first)
        self.sizes = sorted({int(min(n, WINDOW)) for n in length[able]})
        owner = np.repeat(np.arange(len(length)), length)
        hashes, words = [], []
        for size in self.sizes:
            h, w = _sized(items, size)
            own = (np.minimum(length[owner[w]], WINDOW) == size) & able[owner[w]]
            hashes.append(h[own])
            words.append(w[own])
        h, w = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((hashes, np.uint64), (words, np.int64)))
        order = np.argsort(h, kind="stable")
        self.keys, self.begin = np.unique(h[order], return_index=True)
        self.begin = np.append(self.begin, len(h))
        self.word, self.owner = w[order], owner[w[order]]
        self.door = np.zeros(1 << 20, bool)  # whether any key has these upper 20 bits
        self.door[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def met(self, t: Template) -> dict[tuple[int, int, int], list[tuple[int, int]]]:
        """By text, item and diagonal: the first word and the size of each window that both have."""
        met: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        if not len(self.keys):
            return met
        for size in self.sizes:
            h, word = _sized(t, size)
            maybe = np.flatnonzero(self.door[(h >> np.uint64(44)).astype(np.int64)])
            key = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            hit = self.keys[key] == h[maybe]
            text = np.searchsorted(t.first, word[maybe[hit]], "right") - 1
            for k, w, d in zip(key[hit].tolist(), word[maybe[hit]].tolist(), text.tolist()):
                for x in range(self.begin[k], self.begin[k + 1]):
                    met.setdefault((d, int(self.owner[x]), w - int(self.word[x])), []).append((w, size))
        return met


def _joined(at: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Begin and end of the runs that windows on one diagonal make."""
    at = sorted(set(at))
    begin, end = at[0][0], at[0][0] + at[0][1]
    for w, size in [*at[1:], (1 << 60, 0)]:
        if w <= end:
            end = max(end, w + size)
            continue
        yield begin, end
        begin, end = w, w + size


class Index:
    """The windows of a block of items, of their templates and of their folded words."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        self.ids = ids
        whole = pa.array([t or "" for t in texts], pa.large_string())
        self.items = template(whole)
        self.typed = Table(self.items, np.diff(self.items.first) >= LITERAL)
        plain = folded(whole)
        self.length = np.diff(plain.first)
        worded = np.concatenate([[0], np.cumsum(~_DIGIT[plain.data[plain.start]], dtype=np.int32)])
        self.plain = Table(plain, np.diff(worded[plain.first]) > 0)

    def found(self, texts: pa.LargeStringArray) -> dict[int, list[dict]]:
        """By text, what it leaks by template, and the copies of other items. texts has no nulls."""
        out = self._typed(texts)
        for d, copies in self._copies(texts).items():
            out[d] = copies | out.get(d, {})
        return self._told(out)

    def _told(self, found: dict[int, dict[int, dict]]) -> dict[int, list[dict]]:
        return {d: [own[i] for i in sorted(own)] for d, own in found.items()}

    def _copies(self, texts: pa.LargeStringArray) -> dict[int, dict[int, dict]]:
        """By text and item, the longest run of the item's folded words that the text holds."""
        longest: dict[tuple[int, int], int] = {}
        for (d, item, _), at in self.plain.met(folded(texts)).items():
            n = max(end - begin for begin, end in _joined(at))
            if n >= min(RUN, self.length[item]):
                longest[d, item] = max(n, longest.get((d, item), 0))
        out: dict[int, dict[int, dict]] = {}
        for (d, item), n in longest.items():
            out.setdefault(d, {})[item] = {"item_id": self.ids[item], "words": n, "share": n / int(self.length[item]), "kind": "exact"}
        return out

    def leaks(self, texts: pa.LargeStringArray) -> dict[int, list[dict]]:
        """By text, what it leaks by template. texts has no nulls."""
        return self._told(self._typed(texts))

    def _typed(self, texts: pa.LargeStringArray) -> dict[int, dict[int, dict]]:
        t = template(texts)
        found: dict[int, dict[int, dict]] = {}
        for (d, item, shift), at in self.typed.met(t).items():
            length = int(self.items.first[item + 1] - self.items.first[item])
            if (span := self._span(t, at, shift, min(RUN, length))) is None:
                continue
            leak = {"item_id": self.ids[item], "words": span[0], "share": span[0] / length, "kind": span[1]}
            own = found.setdefault(d, {})
            if item not in own or (leak["words"], leak["kind"] == "exact") > (own[item]["words"], own[item]["kind"] == "exact"):
                own[item] = leak
        return found

    def _span(self, t: Template, at: list[tuple[int, int]], shift: int, least: int) -> tuple[int, str] | None:
        """The longest consistent aligned run on a diagonal with `least` words, and its kind."""
        best = None
        for begin, end in _joined(at):
            if end - begin >= least and (kind := self._kind(t, begin, end, shift)) and (best is None or end - begin > best[0]):
                best = (end - begin, kind)
        return best

    def _kind(self, t: Template, begin: int, end: int, shift: int) -> str | None:
        there: dict[bytes, bytes] = {}
        back: dict[bytes, bytes] = {}
        kind = "exact"
        for k in range(begin, end):
            if t.slot[k]:
                a, b = self.items.value(k - shift), t.value(k)
                if there.setdefault(a, b) != b or back.setdefault(b, a) != a:
                    return None
                kind = kind if a == b else "reparameterised"
        return kind


def blocks(benchmark: DataFrame, most: int = BLOCK) -> list[str]:
    """Files with the indices, sent to the executors; their names there. The driver holds one block at a time."""
    spark = benchmark.sparkSession
    texts = distinct(benchmark)
    total = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    n, names = -(-total // most), []
    texts = written(texts, "items") if n > 1 else texts
    for k in range(n):
        rows = texts.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).toArrow()
        name = f"block-{uuid.uuid4().hex}.bin"
        with tempfile.TemporaryDirectory() as folder:
            local = os.path.join(folder, name)
            with open(local, "wb") as f:
                pickle.dump(Index(rows.column("i").to_pylist(), rows.column("t").to_pylist()), f)
            path = f"{new_path(spark, 'block')}/{name}"
            put_file(spark, local, path)
        spark.sparkContext.addFile(path)
        names.append(name)
    return names


def distinct(benchmark: DataFrame) -> DataFrame:
    """The items' different texts (t) and the least id of each (i)."""
    some = benchmark.where(F.length("text") > 0)
    return some.groupBy(F.col("text").alias("t")).agg(F.min(F.col("item_id").cast("long")).alias("i")).select("i", "t")


@functools.lru_cache(1)
def _block(name: str) -> Index:
    with open(SparkFiles.get(name), "rb") as f:
        return pickle.load(f)


def annotate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, name: str = "leaks") -> DataFrame:
    """The columns `keep` of docs (all, if not given), and an array of what each row's text leaks: item_id (the least
    of equal items), words of the run, its share of the item's, and kind; empty where it leaks nothing. docs has a
    column text."""
    keep = docs.columns if keep is None else keep
    kept = [F.col(f"`{c}`") for c in keep]
    names = blocks(benchmark)
    if not names:
        return docs.select(*kept, F.array().cast(LEAKS).alias(name))
    inputs, at = with_text(docs, keep)
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(name, LEAKS)])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("words", pa.int32()), ("share", pa.float64()), ("kind", pa.string())]))

    def joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[list[dict]]] = [[[] for _ in range(b.num_rows)] for b in held]
        for block in names:
            for own, batch in zip(found, held):
                for start, piece in chunks(batch.column(at)):
                    for d, leaks in _block(block).found(piece).items():
                        own[start + d] += leaks
        for own, batch in zip(found, held):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(own, kind)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if len(names) == 1 or sum(b.nbytes for b in held) >= HELD:
                yield from joined(held)
                held = []
        if held:
            yield from joined(held)

    return inputs.mapInArrow(run, schema)


def leaked(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each row of docs and item that it leaks: the key, item_id, words, share, kind."""
    rows = annotate(docs, benchmark, [key]).select(key, F.inline("leaks"))
    items = benchmark.where(F.length("text") > 0).select(F.col("text").alias("t"), F.col("item_id").cast("long").alias("also"))
    again = items.groupBy("t").agg(F.min("also").alias("least"), F.collect_list("also").alias("all"))
    again = again.where(F.size("all") > 1).select("least", "all")
    told = rows.join(again, rows["item_id"] == again["least"], "left")
    own = F.explode(F.coalesce("all", F.array("item_id"))).alias("item_id")
    return told.select(key, own, "words", "share", "kind")
