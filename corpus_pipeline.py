"""A corpus pipeline over `documents`: stages that each work on all rows the stage before kept.

language ID    drops texts without letters, and those far from every learned language
near copies    keeps one document of each class of the n-gram Jaccard join
decontaminate  drops documents that hold a benchmark item, also with other numbers or names
secrets        replaces secrets in texts by a mark; n_chars follows where a text changes
encode         returns each document's token counts and digests

All but the last return the columns of their input, extra ones too. Null and empty texts go at the first stage;
null ids are kept, and repeated rows are copies of each other, of which one stays."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asserta.llm import bpe, decontam, jaccard, langid, secrets
from asserta.llm._common import table, written

#: A score (1 - distance / the largest distance) under which a text fits no learned language.
LEAST_SCORE = 0.15


def packed(docs: DataFrame) -> DataFrame:
    """Each row's other columns as one struct beside its id and text, so that no column's name can meet a name of an
    operator, and no text travels twice."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc__"), "doc_id", "text")


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns as they were, but for those changed."""
    own = {"text": F.col("text")} | changed
    return rows.select(*[own.get(c, F.col("doc__").getField(c)).alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from a bounded sample of the labelled documents; drops `und` and what scores under LEAST_SCORE."""
    named = langid.predict(packed(docs), langid.fit(docs), ["doc__", "text"])
    return unpacked(named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unpacked(jaccard.near_duplicates(packed(docs), ["doc__", "text"]).where("keeper"), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unpacked(decontam.annotate(packed(docs), table(spark, sf_dir, "benchmark"), ["doc__", "text"]).where(F.size("leaks") == 0), docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars, where there is one, follows a text that changes."""
    out = secrets.redact(packed(docs).withColumn("before__", F.col("text")))
    changed = {}
    if "n_chars" in docs.columns:
        same = F.col("text").eqNullSafe(F.col("before__"))
        changed["n_chars"] = F.when(same, F.col("doc__").getField("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return unpacked(out, docs.columns, **changed)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("near copies", drop_copies),
    ("decontaminate", decontaminate),
    ("secrets", redact_secrets),
    ("encode", encode),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "_"))
    return docs
