"""The queries of this package and their SQL. Each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import ann, chat, html_templates, line_dedup, mixing, packing, quality, simhash, token_store, winnow
from lexigrid.llm.common import table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 50, each against all vectors."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=50)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_shards(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens=token_store.token_count(spark, F.col("text")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_templates.extract(table(spark, sf_dir, "pages"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.winnow(table(spark, sf_dir, "documents"))


def op7_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def chat_several_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's operator on dialogues of more than two, which the table lacks: its users are three persons."""
    return chat.rotate(chat.several_users(table(spark, sf_dir, "conversations")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), mixing.TARGET_WEIGHTS)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_nearest_neighbours, op2_simhash_near_dedup, op3_token_shards, op4_best_fit_packing, op5_html_text, op6_winnowing, op7_chat_perspectives, chat_several_users, op8_quality_classifier, op9_mix_sources, op10_line_dedup]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """None for 1 to 6 and 8: they are compared with brute force in tests/llm."""
    return {"op7_chat_perspectives": chat.oracle_sql(), "chat_several_users": chat.oracle_sql(conversations=chat.SEVERAL_USERS), "op9_mix_sources": mixing.oracle_sql(weights=mixing.TARGET_WEIGHTS), "op10_line_dedup": line_dedup.oracle_sql()}
