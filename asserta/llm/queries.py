"""The registered queries of the operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asserta.llm import bpe, chat, decontam, html_extract, jaccard, langid, lm, media, secrets, url_filter
from asserta.llm._common import table


def remainder(of: str, by: int) -> Column:
    """crc32(id as text) modulo `by`; a null id has none."""
    return F.pmod(F.crc32(F.col(of).cast("string").cast("binary")), F.lit(by))


#: Fixed values of the contract: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

URL_SQL = r"""
WITH parsed AS (
    SELECT page_id, url,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
), rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
    SELECT page_id, host, path, (
        SELECT arg_max(struct_pack(rule := h || p, v := v), length(h || p)) FROM rules
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS r
    FROM parsed
)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.v, 'allow') AS verdict FROM best
"""


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULES)
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.digests(rows.unionAll(more))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 1, F.lit(False)))
    return lm.score(docs, docs.where(~F.col("held_out")), ["doc_id", "held_out"])


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id", "url"])


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).drop("keeper")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_langid": op2_langid,
        "op3_bpe": op3_bpe,
        "op4_secrets": op4_secrets,
        "op5_chat": op5_chat,
        "op6_lm": op6_lm,
        "op7_html": op7_html,
        "op8_media": op8_media,
        "op9_jaccard": op9_jaccard,
        "op10_decontam": op10_decontam,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": URL_SQL, "op4_secrets": secrets.SQL, "op5_chat": chat.SQL, "op9_jaccard": jaccard.SQL}
