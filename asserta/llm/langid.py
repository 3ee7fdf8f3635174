"""Language identification by rank-order profiles.

A profile lists a language's most frequent 1- to 3-grams of letters by rank. A text's own most frequent n-grams are
ranked the same way; its distance from a language is the sum over them of how far each is out of place there, or
`size` where the profile lacks it. The nearest language wins, ties by name.

Learning: a bounded sample, `per_language` different labelled texts of each language at most (those whose hashed text is
least, so equal tables give equal models). All labels are learned; the driver holds SIZE n-grams of each. Prediction
reads only the text; a long one is read in pieces, with the same n-grams as in one.

Edge cases: a null text, an empty one and one without letters give ``und`` and score 0; so does every text where
nothing was learned. Null labels aren't learned from. Rows are independent, so repeated rows, null ids and ties
change nothing; columns of other names are carried or dropped as `predict` is told, never mixed up with its own."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asserta.llm._common import chunks, with_text

UNKNOWN = "und"
SIZE = 300  # n-grams in a profile
PER_LANGUAGE = 1500  # labelled texts learned from, for each language, at most
SPACE = 1  # the code of a space in an n-gram; 0 would make n-grams of different lengths equal
PIECE = 1 << 19  # characters counted at once
_letters: list[np.ndarray] = []


class Profiles(NamedTuple):
    names: list[str]
    codes: np.ndarray  # all n-grams of all profiles, ascending
    begin: np.ndarray  # where each n-gram's entries begin in what follows, and the last end
    name: np.ndarray  # the place of a language that has the n-gram
    rank: np.ndarray  # its rank there

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]]) -> Profiles:
        """rows: language, n-gram, rank."""
        names = sorted({lang for lang, _, _ in rows})
        place = {x: i for i, x in enumerate(names)}
        table = np.array(sorted((code, place[lang], rank) for lang, code, rank in rows), np.int64).reshape(-1, 3)
        codes, begin = np.unique(table[:, 0], return_index=True)
        return cls(names, codes, np.append(begin, len(table)), table[:, 1], table[:, 2])


def letter_codes() -> np.ndarray:
    """For each code point 0 if it isn't a letter, else a number of 16 bits; those beyond the basic plane are folded."""
    if not _letters:
        code = np.arange(0x110000, dtype=np.uint32)
        alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _letters.append(np.where(alpha, np.maximum(code & 0xFFFF ^ code >> 16 << 11 & 0xFFFF, SPACE + 1), 0).astype(np.int64))
    return _letters[0]


def _grams(text: str) -> Iterator[np.ndarray]:
    """Codes of all 1- to 3-grams of the lower-cased text with a space before and after, where a run of other
    characters counts as one space; n-grams of the space alone don't count. By pieces; the last two letters or spaces
    of one go over to the next."""
    codes, lowered = letter_codes(), text.lower()
    carried = np.array([SPACE], np.int64)
    for at in range(0, max(1, len(lowered)), PIECE):
        piece = lowered[at : at + PIECE] + " " * (at + PIECE >= len(lowered))
        units = np.maximum(codes[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)], SPACE)
        before = np.concatenate([carried[-1:], units[:-1]])
        units = units[(units != SPACE) | (before != SPACE)]
        whole, k = np.concatenate([carried, units]), len(carried)
        two = whole[:-1] << 16 | whole[1:]
        three = two[:-1] << 16 | whole[2:]
        yield np.concatenate([units[units > SPACE], two[k - 1 :], three[max(0, k - 2) :]])
        carried = whole[-2:]


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, count), by text, then code."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if waiting:
            keys = np.concatenate(waiting)
            keys.sort()
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            at = np.flatnonzero(new)
            parts.append((keys[at], np.diff(np.append(at, len(keys)))))
            waiting.clear()
            size = 0

    for d, text in enumerate(texts):
        for grams in _grams(text):
            waiting.append(grams | np.int64(d) << 48)
            size += len(grams)
            if size >= 3 * PIECE:
                flush()
    flush()
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    if len(parts) > 1:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        keys, counts = keys[at], np.add.reduceat(counts, at) if len(at) else counts
    return keys >> 48, keys & ((1 << 48) - 1), counts


def _ranked(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, rank from 0) of each text's SIZE most frequent n-grams; ties by code."""
    text, code, count = _counted(texts)
    order = np.argsort(text << 32 | (1 << 31) - np.minimum(count, (1 << 31) - 1), kind="stable")
    text, code = text[order], code[order]
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    top = rank < SIZE
    return text[top], code[top], rank[top]


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Profiles:
    """labelled: columns text and lang. What reaches the driver: the labels, then SIZE rows for each."""
    pick = F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("pick")
    known = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang", pick)
    # Different texts are counted by a sketch of a few kB; its error of 2 % is far less than what the share has to spare
    kinds = known.groupBy("lang").agg(F.approx_count_distinct("pick", 0.02).alias("kinds"))
    counts = kinds.collect()
    if not counts:
        return Profiles([], *(np.zeros(n, np.int64) for n in (0, 1, 0, 0)))
    # A share by hash that leaves about 1.3 times the wanted number of different texts, then the least hashes among those
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.3 * per_language / r["kinds"]))])
    some = known.where(F.col("pick") < share[F.col("lang")] * F.lit(float(1 << 40)))
    some = some.dropDuplicates(["lang", "pick"])  # copies count once: a text that fills a third of the table is one row here
    first = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("pick", "text"))).where(F.col("n") <= per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in set(langs):
                texts = [t for t, x in zip(batch.column("text").to_pylist(), langs) if x == lang]
                _, code, n = _counted(texts)
                kinds, at = np.unique(code, return_inverse=True)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(kinds), "code": kinds, "n": np.bincount(at, n, len(kinds)).astype(np.int64)})

    grams = first.select("text", "lang").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = grams.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")) - 1).where(F.col("rank") < SIZE)
    rows = best.select("lang", "code", "rank").collect()
    return Profiles.of([tuple(r) for r in rows])


def classify(texts: list[str | None], model: Profiles) -> tuple[list[str], np.ndarray]:
    """The nearest language of each text and 1 - distance / the largest distance possible."""
    text, code, rank = _ranked([t or "" for t in texts])
    named, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not len(text) or not model.names:
        return named, score
    at = np.minimum(np.searchsorted(model.codes, code), len(model.codes) - 1)
    begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    own = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(text))))
    # An n-gram that a profile has is SIZE less its distance nearer to it than one that it lacks
    known = np.flatnonzero(model.codes[at] == code)
    many = model.begin[at[known] + 1] - model.begin[at[known]]
    entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(model.begin[at[known]], many)
    gram = np.repeat(known, many)
    nearer = SIZE - np.abs(model.rank[entry] - rank[gram])
    n = len(model.names)
    total = SIZE * np.bincount(own)[:, None] - np.bincount(own[gram] * n + model.name[entry], nearer, len(begin) * n).reshape(-1, n)
    best = total.argmin(axis=1)
    most = SIZE * np.diff(np.append(begin, len(text)))
    for d, b, s in zip(text[begin], best, 1 - total[np.arange(len(begin)), best] / most):
        named[d], score[d] = model.names[b], s
    return named, score


def predict(docs: DataFrame, model: Profiles, keep: list[str], named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs, then the language and the score, as `named`. The profiles are broadcast: SIZE
    n-grams for each label. docs has a column text; `keep` has neither of the two new names."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    inputs, at = with_text(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, piece in chunks(batch.column(at)):
                langs, score = classify(piece.to_pylist(), held.value)
                rest = [batch.column(i).slice(start, len(piece)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(langs, pa.string()), pa.array(score)], names=[*keep, *named])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias(named[0]), F.lit(0.0).alias(named[1])).schema
    return inputs.mapInArrow(run, schema)
