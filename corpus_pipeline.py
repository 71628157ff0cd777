"""Corpus pipeline over ``documents``: language ID, near-duplicates, leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of ``docs``, whatever those are. An empty table
stays empty through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridvalue.functions import settle
from gridvalue.llm import bpe, decontaminate, language, simhash
from gridvalue.llm.common import free_prefix, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID, learned from all labelled ones, does not reject.

    Rejected: null texts, texts without a letter, texts far from every language.
    """
    model = language.fit(docs)
    p = free_prefix(docs)
    return language.add_language(docs, model, prefix=p).where(~F.col(f"{p}rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one with the smallest id. A class is what a chain
    of pairs connects whose fingerprints of three-word shingles differ in at most 2 bits."""
    return simhash.keep_one_per_class(docs, radius=2, shingle=3)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each document; a null text
    has no ids."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    made = bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return bpe.round_trip(made, ranks, keep=("ids",))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("token_ids", to_token_ids),
]

#: Clustering, fingerprint components and BPE are beyond SQL; tests hold the rows
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
