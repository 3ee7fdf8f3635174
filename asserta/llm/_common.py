"""What the operators share: tables written to the folder all machines see, row chunks, Bloom bits in SQL expressions."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asserta.sources.workspace import new_path


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """df cut from its lineage: written once as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, what runs sends at most `rows` rows at once to Python, where the session would send more: a batch is in
    memory some times over, in the JVM and in the worker. The setting is the session's, and is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, min(before, rows) if before > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_text(docs: DataFrame, keep: list[str], name: str = "text") -> tuple[DataFrame, int]:
    """What a mapInArrow function reads: the columns `keep`, and the text last unless it is among them, so that no
    text travels twice; and the text's place."""
    kept = [F.col(f"`{c}`") for c in keep]
    if name in keep:
        return docs.select(*kept), keep.index(name)
    return docs.select(*kept, F.col(name).alias("text_read")), len(keep)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(texts: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) so that each piece has about `most` bytes, or is one longer text. Nulls become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    start = size = 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        if i > start and size + n > most:
            yield start, texts.slice(start, i - start)
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, texts.slice(start)
    pa.default_memory_pool().release_unused()


@functools.lru_cache(1)
def one_thread() -> None:
    """Has numpy's BLAS use one thread in this process: Spark runs a Python worker for each core, and further threads
    only wait for each other over small matrices. Where the library isn't found nothing changes."""
    try:
        with open("/proc/self/maps", encoding="utf-8", errors="replace") as f:
            paths = {x.split(None, 5)[-1].strip() for x in f if "openblas" in x}
    except OSError:
        return
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


#: Bits of a Bloom filter at most: 8 MB, the proven bound of what a scalar subquery ships.
MOST_BITS = 1 << 26


def _slots(key: Column, seed: int, bits: int, hashes: int) -> list[Column]:
    """Bit positions of a key by double hashing."""
    a, b = (F.pmod(F.xxhash64(F.lit(s), key), F.lit(bits)) for s in (seed, ~seed))
    return [F.pmod(a + F.lit(i) * b, F.lit(bits)) for i in range(hashes)]


def word_bits(spots: DataFrame, bits: int) -> DataFrame:
    """One row with column ``bits``, array<bigint> of bits/64 words, in which the bits numbered by column p of spots
    are set. The words are OR-ed before the shuffle, so what moves is at most bits/64 rows per task, however many
    spots there are."""
    if bits > MOST_BITS or bits % 64:
        raise ValueError(f"{bits} bits: a multiple of 64 up to {MOST_BITS} is needed")
    words = spots.select((F.col("p") / 64).cast("long").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
    dense = words.unionAll(spots.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b")))
    one = dense.groupBy("w").agg(F.bit_or("b").alias("b")).agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("x"))
    return one.select(F.transform("x", lambda x: x["b"]).alias("bits"))


def bloom_bits(keys: DataFrame, key: str, seed: int, bits: int, hashes: int) -> DataFrame:
    """The Bloom filter of a column's keys as `word_bits` gives it; null keys aren't in it."""
    slots = F.explode(F.array(*_slots(F.col(key), seed, bits, hashes)))
    return word_bits(keys.where(F.col(key).isNotNull()).select(slots.alias("p")), bits)


def bloom_has(bits: Column, key: Column, seed: int, size: int, hashes: int) -> Column:
    """Whether all bits of a key are set in the array<bigint> `bits`; a null key has none."""
    test = F.lit(True)
    for p in _slots(key, seed, size, hashes):
        word = F.element_at(bits, (p / 64).cast("int") + 1)
        test = test & (F.call_function("getbit", word, (p % 64).cast("int")) == 1)
    return key.isNotNull() & test
