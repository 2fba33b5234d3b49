"""The corpus pipeline: from raw documents to a deduplicated, mixed and tokenized corpus.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept; all but the last return the columns of docs. The quality rules drop the rows
that they reject; of equal texts the row with the largest id stays; of similar
documents (five words, Jaccard 0.8) the row with the least id stays; the mix drops and
repeats rows, so that the sources come near their targets, and deals them out to
shards; the last stage returns the ids of every row and the hash of what they decode to.

Null ids, texts, langs and sources, repeated rows, an empty table and further columns are
handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import byte_bpe, exact_dedup, jaccard, mixing, quality
from claimloom.llm.common import discard, documents, written
from claimloom.llm.queries import MOST, SHARE, WEIGHTS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.one_of_each(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sharded(docs, WEIGHTS, SHARE, MOST)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can't express the mix; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            discard(docs)  # the stage before's table: nothing reads it any more
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
