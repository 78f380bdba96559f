"""Queries p1, p7, p8 and p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import abuse, mixture, sources, tokens
from factloom.plans.tables import table
from factloom.session import scratch_path


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sources.verdicts(table(spark, d, "source_files")).where("not valid").select("file_id").distinct()


def p1_failures(spark: SparkSession, d: str) -> DataFrame:
    return sources.verdicts(table(spark, d, "source_files")).where("not valid").drop("valid").distinct()


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return sources.invalid_rates(sources.verdicts(table(spark, d, "source_files")))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(spark, table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    mixed, plan = mixture.mix(spark, table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixture.reached(spark, mixed, plan)


def p8_shards(spark: SparkSession, d: str) -> DataFrame:
    """The shards as written and read again: rows, tokens and sources of each."""
    mixed, _ = mixture.mix(spark, table(spark, d, "documents"), table(spark, d, "mix_targets"))
    written = mixture.write_shards(mixed, scratch_path(spark, "shards"))
    return written.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("n_tokens"), F.countDistinct("source").alias("n_sources"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents")).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abuse_rates(abuse.scores(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p1_found, p1_failures, p1_rates, p7_ids, p8_mixture, p8_shares, p8_shards, p9_found, p9_scores, p9_rates)}
SQL: dict[str, str] = {}
