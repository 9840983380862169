"""A training corpus out of the documents: filter, clean, deduplicate, mix and pack. Counted as part of lexigrid.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import line_dedup, mixing, packing, quality, simhash
from lexigrid.llm.common import saved, table
from lexigrid.llm.token_store import token_count


# Every stage takes null and empty texts, null ids, repeated rows, ties, empty tables and further columns as the docstring of
# its operator says: nothing but what the operator decides goes, and all columns stay up to the last stage.


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of the trusted ones doesn't exceed their language's threshold. Null and empty
    texts go; repeated rows are judged each for itself; an empty table gives an empty one; without labels all texts stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that recur across sites; one of such lines alone stays whole. Null and empty texts stay as
    they are, repeated rows are cleaned alike; an empty table gives an empty one."""
    return line_dedup.remove_boilerplate(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least doc_id, nulls last; of repeated rows one. Texts without words
    are all kept; an empty table gives an empty one."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of weighted fair queueing over sources, to mixing.TARGET_WEIGHTS, up to half of all tokens. Null
    sources are one source, null texts have no tokens, ties go by hash; an empty table gives an empty one."""
    return mixing.mixed_documents(docs, mixing.TARGET_WEIGHTS, tokens=token_count(spark, F.col("text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of training sequences: bin_id, slot, doc_id, piece, start_token, n_tokens; a token is an id of op3's tokenizer. Texts
    without tokens are in no bin; null doc_ids and repeated rows are packed each for itself; an empty table gives an empty one."""
    return packing.pack(docs, tokens=token_count(spark, F.col("text")))


STAGES = [("quality", good_quality), ("line dedup", without_boilerplate), ("near dedup", one_of_each_group), ("mixing", mixed), ("packing", packed)]

#: Perplexity, SimHash grouping and greedy packing can't be expressed in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each stage's rows written and read again before the next. Nulls, ties, repeated rows, empty
    tables and further columns are as the stages say."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
