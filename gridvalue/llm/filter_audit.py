"""Interaction audit of document filters: what each removes in every order of applying them.

Filters that look at one text are column expressions and give each document a bit mask.
The filter against exact copies is an existential self-join: a left-semi join on hash,
exact text and smaller key. Its right side holds one row per text, with the smallest key,
so a text of very many copies meets one row; only texts whose hash comes twice are
shuffled. The keys it marks are united with the other failures, each document's bits are
combined, and only the number of documents of each bit combination goes on: every order
and step, and the filters' Shapley values, are sums over those few counts.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import settle
from .common import empty_if_null

#: Words are what lies between these characters.
SPACE = r"[\x20\x09-\x0D]+"

LEAST_WORDS = 200
LEAST_DISTINCT = 50  # hundredths of the words
MOST_CAPITALS = 3    # hundredths of the code points
SIGNS = "[#$%&*|]"


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null."""
    words = F.array_remove(F.split(text, SPACE, -1), "")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS * F.char_length(text),
        "D": text.rlike(SIGNS),
    }


def copies_of_smaller(docs: DataFrame) -> DataFrame:
    """(key, part, hash) of the documents (key, part, text, hash) whose text a smaller key
    has, once for repeated rows."""
    twice = docs.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    some = docs.join(settle(twice, "repeated_hashes"), "hash", "left_semi")
    # Written, so that the join reads plain exchanges, whose hot texts Spark can split.
    smallest = settle(some.groupBy("hash", "text").agg(F.min("key").alias("least")), "smallest_keys")
    x, y = some.alias("x"), smallest.alias("y")
    smaller = (F.col("x.hash") == F.col("y.hash")) & (F.col("x.text") == F.col("y.text")) & (
        F.col("y.least") < F.col("x.key"))
    return x.join(y, smaller, "left_semi").select("key", "part", "hash").distinct()


def failure_masks(docs: DataFrame, conditions: Mapping[str, Column], copies: bool) -> DataFrame:
    """(key, part, hash, mask, n) of the documents (key, part, text): bit i of the mask is
    set if the i-th condition holds, the bit after the last (with ``copies``) if a smaller
    key has the same text; ``n`` is the number of such rows."""
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions.values())]
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    rows = hashed.select("key", "part", "hash", reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0)).alias("mask"),
                         F.lit(1).cast("long").alias("n"))
    if copies:
        marked = copies_of_smaller(hashed).select(
            "key", "part", "hash", F.lit(1 << len(bits)).alias("mask"), F.lit(0).cast("long").alias("n"))
        rows = rows.unionByName(marked)
    return rows.groupBy("key", "part", "hash").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))


def _steps(letters: Sequence[str]) -> Column:
    """All (filter_order, step, bit, before) as one constant array; ``before`` has the
    bits of the filters applied earlier."""
    bit = {c: 1 << i for i, c in enumerate(letters)}
    rows = [
        {"filter_order": "".join(order), "step": k + 1, "bit": bit[c], "before": sum(bit[x] for x in order[:k])}
        for order in itertools.permutations(letters) for k, c in enumerate(order)
    ]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")


def interactions(counts: DataFrame, letters: Sequence[str]) -> DataFrame:
    """Every order and step of the filters from (part, mask, n, good, toxic), one row of
    each part and mask."""
    each = counts.select("part", "mask", "n", "good", "toxic", F.explode(_steps(letters)).alias("s"))
    each = each.select("part", "mask", "n", "good", "toxic", "s.*")
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0

    def total(where: Column, what: str | Column = "n") -> Column:
        what = F.col(what) if isinstance(what, str) else what
        return F.sum(F.when(where, what).otherwise(F.lit(0))).cast("long")

    # Of all orders, a document's failing filters come first equally often.
    orders = math.factorial(len(letters))
    share = F.col("n") * F.expr(f"{orders} div greatest(bit_count(mask), 1)")
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"), total(mask == bit).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
        total(fails, share).alias("shapley"))


def audit(
    docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column] | None = None, copies: str | None = "E",
    key: str = "doc_id", text: str = "text", part: str = "lang",
) -> DataFrame:
    """One row per (part, filter_order, step) for all orders of the filters.

    ``conditions`` names each filter by a letter and says, of a column ``text``, when it
    fails (default: :func:`text_conditions`); ``copies`` is the letter of the filter
    against exact copies, or None. ``labels`` has the key, ``quality`` and ``toxic``.

    A null text is empty and a null part the empty string. Every row is a document:
    of rows with one key and text none is the smaller. A null key is neither smaller than
    another nor larger, so it is no copy, and has no label. A document with several
    labels is good (toxic) if one of them says 1. An empty table gives no rows; a part
    has all orders and steps, zeros included. Steps grow as the factorial of the filters.
    """
    body = empty_if_null(F.col(text))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"), body.alias("text"))
    conditions = dict(conditions or text_conditions(F.col("text")))
    letters = [*conditions, *([copies] if copies else [])]
    masks = failure_masks(rows, conditions, bool(copies))
    known = labels.groupBy(F.col(key).alias("key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counts = masks.join(known, "key", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return interactions(settle(counts, "bit_combinations"), letters)


ORACLE_SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
    SELECT doc_id, part, text,
           list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM docs
), fails AS (
    SELECT doc_id, part, [
        len(words) < 200,
        100 * len(list_distinct(words)) < 50 * len(words),
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
        regexp_matches(text, '[#$%&*|]'),
        EXISTS (SELECT 1 FROM docs y WHERE y.text = words.text AND y.doc_id < words.doc_id)] AS fail
    FROM words
), labelled AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY ALL
), cases AS (
    SELECT part, fail, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM fails LEFT JOIN labelled USING (doc_id)
), l AS (
    SELECT unnest([1, 2, 3, 4, 5]) AS i
), orders AS (
    SELECT [a.i, b.i, c.i, d.i, e.i] AS o
    FROM l a, l b, l c, l d, l e
    WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), grouped AS (
    SELECT part, fail, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM cases GROUP BY ALL
), steps AS (
    SELECT part, o, s.i AS step, o[s.i] AS f, fail, n, good, toxic, fail[o[s.i]] AS failing,
           len(list_filter(o[1:s.i - 1], lambda x: fail[x])) > 0 AS gone
    FROM grouped, orders, l s
), result AS (
    SELECT part, o, step, f,
           sum(CASE WHEN NOT failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN failing AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN failing AND len(list_filter(fail, lambda x: x)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN failing AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM steps GROUP BY ALL
)
SELECT part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, step::INTEGER AS step,
       kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM result
"""
