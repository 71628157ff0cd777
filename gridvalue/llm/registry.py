"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe, chat, decontaminate, filter_audit, fingerprints, html_text, language, line_runs, ranked_search, sharding,
    simhash, token_files, url_filter,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_fingerprints(spark, sf):
    return fingerprints.edit_report(table(spark, sf, "documents"))


@query
def op2_chat(spark, sf):
    return chat.format_chats(table(spark, sf, "conversations"))


ORACLES["op2_chat"] = chat.ORACLE_SQL


@query
def op3_bpe(spark, sf):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip_report(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op4_url_filter(spark, sf):
    return url_filter.filter_urls(table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op4_url_filter"] = url_filter.oracle_sql()


@query
def op5_sharding(spark, sf):
    return sharding.shard_report(table(spark, sf, "documents"))


@query
def op6_decontamination(spark, sf):
    return decontaminate.leak_report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op7_token_files(spark, sf):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return token_files.token_report(table(spark, sf, "documents"), f.read())


@query
def op8_html_text(spark, sf):
    return html_text.extract_pages(table(spark, sf, "pages"))


@query
def op9_simhash(spark, sf):
    return simhash.near_duplicate_report(table(spark, sf, "documents"))


@query
def op10_language(spark, sf):
    return language.held_out_report(table(spark, sf, "documents"))


@query
def op11_ranked_search(spark, sf):
    return ranked_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


ORACLES["op11_ranked_search"] = ranked_search.ORACLE_SQL


@query
def op12_filter_audit(spark, sf):
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


ORACLES["op12_filter_audit"] = filter_audit.ORACLE_SQL


@query
def op13_line_dedup(spark, sf):
    return line_runs.line_report(table(spark, sf, "documents"))


ORACLES["op13_line_dedup"] = line_runs.ORACLE_SQL
