"""The corpus pipeline: toxicity, exact and near duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of `documents`. `run` applies the stages to `documents`, with a Parquet table between two stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from solframe.llm.bpe import encode_documents
from solframe.llm.common import scratch_table
from solframe.llm.exact_dedup import drop_exact_duplicates
from solframe.llm.mixing import apply_mix
from solframe.llm.ngram_jaccard import drop_near_duplicates
from solframe.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Null and empty texts have the score of a text without words and stay; nothing is decided by
    doc_id, so null and repeated ids are judged each by its own text; an empty table stays empty, other columns stay.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space stays: the longest original, then the least
    doc_id, nulls last. Null and empty texts are one group; rows that repeat all of that leave one.
    """
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more; of linked documents, the one with the least doc_id stays. Texts
    without words are linked with nothing and stay.
    """
    return drop_near_duplicates(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number (0 to 2 times). A null source is a
    source, the last one; documents without words go, as no mix takes them; rows that share a doc_id share its count.
    """
    return apply_mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; null and empty texts have none."""
    return encode_documents(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: A trained classifier and a tokenizer file are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
