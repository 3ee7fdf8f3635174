"""Media columns by content-defined chunking.

A payload (a text's UTF-8 bytes, zero bytes up to a positive multiple of 64) is stored as 8-bit unsigned PCM: a
44-byte RIFF header, then a sample for each byte. The samples are cut where a rolling gear hash of the last 32 bytes
has MASK's bits zero, at LEAST bytes or more after the last cut and at MOST at the latest, so equal stretches are cut
alike wherever they stand. A chunk's digest is the first 128 bits of its SHA-256.

Storing: digests that occur twice or more are found by a Spark aggregation over digests alone. A Bloom filter of
them, of bounded size, tells the packing pass which chunks may be shared: those go to the chunk store, kept once for
each digest; the others stay with their row. A false positive only stores a chunk apart, so the filter affects
layout, never content. Reading: rows without shared chunks need no shuffle; references of the others are joined with
the chunk store by digest and put in order. A chunk with HOT references or more is there SALTS times for the join, so
that they don't meet in one task. Rows go to Python ROWS at a time, and what is measured is written at once, so that
this holds for all passes. Every medium is verified against its SHA-256 before use; a mismatch
raises ValueError.

Edge cases: a null text is an empty one, with 64 zero bytes as payload. Rows are kept apart by a number given when
they are packed, so null or repeated ids and repeated rows are safe. Equal texts have equal values. Extra columns are
carried if asked for."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asserta.llm._common import MOST_BITS, bloom_bits, bloom_has, chunks, small_batches, word_bits, written

LEAST, MOST, MASK = 256, 8192, np.uint32(0xFFC00000)
RATE = 8000
PER_KEY, HASHES = 10, 5
HOT, SALTS = 5000, 32
ROWS = 500  # that go to a Python worker at once
_GEAR = np.random.Generator(np.random.PCG64(710)).integers(0, 1 << 32, 256, dtype=np.uint32)
CHUNK = T.StructType([T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("data", T.BinaryType())])


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the padded payload."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def header(n: int) -> bytes:
    """The RIFF header of n samples: mono, 8 bits."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", (36 + n) & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n & 0xFFFFFFFF)


def samples_of(medium: bytes) -> bytes:
    if medium[:4] != b"RIFF" or medium[36:40] != b"data" or struct.unpack("<I", medium[40:44])[0] != (len(medium) - 44) & 0xFFFFFFFF:
        raise ValueError("not a medium of this format")
    return medium[44:]


def cuts(data: np.ndarray, begin: list[int]) -> list[list[int]]:
    """For each payload, from begin[i] to begin[i + 1] in data, the ends of its chunks, relative to its begin. The
    hash at a byte is the sum of gear values of the last 32 bytes, the k-th last shifted by k; by doubling windows."""
    rolled = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        rolled[width:] += rolled[:-width] << np.uint32(width)
    spots = np.flatnonzero((rolled & MASK) == 0) + 1
    out = []
    for a, b in zip(begin, begin[1:]):
        own, last, ends = spots[np.searchsorted(spots, a) : np.searchsorted(spots, b)].tolist(), a, []
        for spot in [*own, b]:
            while spot - last > MOST:
                last += MOST
                ends.append(last - a)
            if spot - last >= LEAST and spot < b:
                last = spot
                ends.append(last - a)
        if last < b:
            ends.append(b - a)
        out.append(ends)
    return out


def digest(chunk: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.sha256(chunk).digest()[:16])


def cut(texts: list[str | None]) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """(bytes of the text, header, chunks of the samples) of each text."""
    made = [payload_of(t) for t in texts]
    whole = b"".join([p for _, p in made])
    begin = [0, *np.cumsum([len(p) for _, p in made]).tolist()]
    for (n, p), ends in zip(made, cuts(np.frombuffer(whole, np.uint8), begin)):
        yield n, header(len(p)), [p[a:b] for a, b in zip([0, *ends], ends)]


def _may_be_shared(bits: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    size = len(bits) * 64
    a, b = d1 % size, d2 % size
    out = np.ones(len(d1), bool)
    for i in range(HASHES):
        p = (a + i * b) % size
        out &= bits[p >> 6] >> (p & 63) & 1 == 1
    return out


def shared_bits(docs: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """A Bloom filter, at most MOST_BITS long, of the digests that occur twice or more; and the first halves of those
    that occur HOT times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, piece in chunks(batch.column(0)):
                found = np.array([digest(c) for _, _, parts in cut(piece.to_pylist()) for c in parts], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["d1", "d2"])

    counts = docs.select(F.col("text").alias("text_read")).mapInArrow(run, "d1 long, d2 long").groupBy("d1", "d2").count()
    twice = written(counts.where("count > 1"), "shared")
    size = min(MOST_BITS, max(64, -(-twice.count() * PER_KEY // 64) * 64))
    a, b = (F.pmod(c, F.lit(size)) for c in ("d1", "d2"))
    spots = twice.select(F.explode(F.array(*[F.pmod(a + F.lit(i) * b, F.lit(size)) for i in range(HASHES)])).alias("p"))
    return np.array(word_bits(spots, size).first()["bits"], np.int64), twice.where(F.col("count") >= HOT).select("d1")


def pack(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, chunk store, first halves of much shared digests), all written. Rows: the columns `keep`, a number, and of each medium its header, digest
    and ordered chunks, whose data are null where the store has them."""
    shared, hot = shared_bits(docs)
    bits = docs.sparkSession.sparkContext.broadcast(shared)
    kept = [F.col(f"`{c}`") for c in keep]
    new = T.StructType(
        [T.StructField("text_bytes", T.LongType()), T.StructField("head", T.BinaryType()), T.StructField("sha256", T.StringType()), T.StructField("chunks", T.ArrayType(CHUNK)), T.StructField("apart", T.ArrayType(CHUNK))]
    )
    schema = T.StructType(docs.select(*kept).schema.fields + new.fields)
    kinds = pa.list_(pa.struct([("d1", pa.int64()), ("d2", pa.int64()), ("data", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for start, piece in chunks(batch.column(batch.num_columns - 1)):
                made = list(cut(piece.to_pylist()))
                digests = [[digest(c) for c in parts] for _, _, parts in made]
                flat = np.array([d for own in digests for d in own], np.int64).reshape(-1, 2)
                maybe = iter(_may_be_shared(bits.value, flat[:, 0], flat[:, 1]).tolist())
                here, apart = [], []
                if len(sent) > 1_000_000:
                    sent.clear()
                for (_, _, parts), own in zip(made, digests):
                    rows, away = [], []
                    for d, c in zip(own, parts):
                        shared = next(maybe)
                        rows.append((*d, None if shared else c))
                        if shared and d not in sent:
                            sent.add(d)
                            away.append((*d, c))
                    here.append(rows)
                    apart.append(away)
                rest = [batch.column(i).slice(start, len(piece)) for i in range(batch.num_columns - 1)]
                whole = [hashlib.sha256(b"".join([h, *parts])).hexdigest() for _, h, parts in made]
                arrays = [pa.array([n for n, _, _ in made], pa.int64()), pa.array([h for _, h, _ in made]), pa.array(whole), pa.array(here, kinds), pa.array(apart, kinds)]
                yield pa.RecordBatch.from_arrays([*rest, *arrays], names=[*keep, *new.names])

    rows = docs.select(*kept, F.col("text").alias("text_read")).mapInArrow(run, schema)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "media")
    store = rows.select(F.inline("apart")).groupBy("d1", "d2").agg(F.first("data").alias("data"))
    return rows.drop("apart"), written(store, "chunks"), hot


def read(rows: DataFrame, store: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows with a column `parts`: the data of the chunks in order."""
    size = min(MOST_BITS, max(64, -(-hot.count() * PER_KEY // 64) * 64))
    bits = written(bloom_bits(hot, "d1", 3, size, HASHES), "bits")
    much = bloom_has(bits.scalar(), F.col("d1"), 3, size, HASHES)  # the same for both sides of the join, right or not
    store = store.withColumn("salt", F.explode(F.when(much, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    lacks = F.exists("chunks", lambda c: c["data"].isNull())
    whole = rows.where(~lacks).withColumn("parts", F.transform("chunks", lambda c: c["data"]))
    refs = rows.where(lacks).select("row", F.posexplode("chunks").alias("place", "c")).where(F.col("c.data").isNull()).select("row", "place", "c.d1", "c.d2")
    refs = refs.withColumn("salt", F.when(much, F.pmod(F.xxhash64("row", "place"), F.lit(SALTS)).cast("int")).otherwise(0))
    fetched = refs.join(store, ["d1", "d2", "salt"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("place", "data"))).alias("from_store"))
    filled = rows.where(lacks).join(fetched, "row").withColumn("parts", F.transform("chunks", lambda c, i: F.coalesce(c["data"], F.element_at("from_store", i))))
    return whole.unionByName(filled.drop("from_store")).drop("chunks")


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and peak from the middle, and the rate of crossings of it."""
    x = samples.astype(np.int64) - 128
    n, s, q = len(x), int(x.sum()), int((x * x).sum())
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"mean={s / n:.6f};dev={max(0.0, q / n - (s / n) ** 2) ** 0.5:.6f};peak={int(np.abs(x).max())};crossings={crossings / n:.6f}"


def measured(media: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and what the stored bytes say. media: as `read` gives it."""
    new = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("n_bytes", "payload_bytes")]
        + [T.StructField("payload_sha256", T.StringType())]
        + [T.StructField(n, T.LongType()) for n in ("tail_crc32", "media_bytes")]
        + [T.StructField(n, T.StringType()) for n in ("media_sha256", "feature")]
    )
    kept = media.select(*[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts, heads, shas, parts = (batch.column(len(keep) + i) for i in range(4))
            for i in range(batch.num_rows):
                medium = b"".join([heads[i].as_py(), *parts[i].as_py()])
                sha = hashlib.sha256(medium).hexdigest()
                if sha != shas[i].as_py():
                    raise ValueError(f"a stored medium has digest {sha} in place of {shas[i].as_py()}")
                p = samples_of(medium)
                out.append((texts[i].as_py(), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(medium), sha, feature(np.frombuffer(p, np.uint8))))
            made = [pa.array(x, pa.string() if f.dataType == T.StringType() else pa.int64()) for x, f in zip(zip(*out) if out else [[]] * 7, new.fields)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *made], names=[*keep, *new.names])

    order = [*[F.col(f"`{c}`") for c in keep], F.col("text_bytes"), F.col("head"), F.col("sha256"), F.col("parts")]
    return media.select(*order).mapInArrow(run, T.StructType(kept.schema.fields + new.fields))


def digests(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Stores the texts of docs, reads them back, and measures what was read. `keep` has no name that this uses."""
    with small_batches(docs.sparkSession, ROWS):
        return written(measured(read(*pack(docs, keep)), keep), "measured")
