"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textmill.llm import chat, decontaminate, langid, maxent, mixing, neardup, pii, quality, rollup, warc
from textmill.llm.common import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(table(spark, d, "pages"), Workspace(spark, "warc"))


def op2_maxent(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return maxent.score(docs, maxent.train(docs))


def op3_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"))


def op4_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollup.maintain(table(spark, d, "documents"), table(spark, d, "labels"), rollup.Rollup(spark, Workspace(spark, "rollup").path))


def op5_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.sanitise(table(spark, d, "documents"))


def op6_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge(table(spark, d, "documents"))


def op7_chat(spark: SparkSession, d: str) -> DataFrame:
    return chat.locate(table(spark, d, "conversations"))


def op8_neardup(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "documents"))


def op9_langid(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return langid.identify(docs, langid.fit(docs))


def op10_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def queries() -> dict:
    own = [op1_warc, op2_maxent, op3_mixing, op4_token_counts, op5_pii, op6_quality, op7_chat, op8_neardup, op9_langid, op10_decontamination]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.SQL, "op3_mixing": mixing.SQL, "op4_token_counts": rollup.SQL}
