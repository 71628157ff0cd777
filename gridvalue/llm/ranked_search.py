"""Ranked lexical search by the Best Position Algorithm over blocks of documents.

A first pass over the texts keeps, of every document, its length and the terms that the
items ask for; Spark sums the corpus statistics from that table. A second pass takes the
table a block at a time, wherever its rows lie, and gives every asked-for term of the
block an impact list: its documents by falling impact. For an item the lists are read
downwards in step. A document met for the first time is accessed directly in all lists:
that gives its whole score, and its position in each list counts as seen. A list's best
position is the end of its unbroken run of seen positions; the impacts there sum to a
bound on every document not seen yet. The block is done once that bound is strictly
below the k-th score found so far, so no document that ties with the k-th is missed.

No list leaves its block, so a term of every document costs a block no more than its own
documents. A task hands on its k best documents of each item, and Spark ranks those.
Items come in blocks too: driver and tasks hold one block of items at a time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import settle, union_all
from .common import slices

TOP = 10
#: Postings that a task searches at once, and bytes of text of the items of a block.
BLOCK_POSTINGS = 1 << 21
ITEM_BYTES = 8 << 20
#: Positions of each list that the first step reads; each further step reads twice as many.
FIRST_STEP = 16
#: Share of a document's length in its normalisation, in hundredths.
LENGTH_SHARE = 75

#: Terms in UTF-8 after A-Z are lower-cased: ASCII digits and letters and all beyond ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str | None) -> Iterator[bytes]:
    return (m[0] for m in TERM.finditer((text or "").encode().lower()))


class Items:
    """The items of a block: their distinct terms, numbered, and how often each asks for one."""

    def __init__(self, texts: list[str | None]):
        self.vocabulary: dict[bytes, int] = {}
        self.asked: list[tuple[np.ndarray, np.ndarray]] = []
        for text in texts:
            counts = Counter(self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms_of(text))
            self.asked.append((np.fromiter(counts, np.int64, len(counts)),
                               np.fromiter(counts.values(), np.int64, len(counts))))


def item_blocks(items: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """The rows of ``items`` (key, text) in blocks of about ``limit`` bytes, one row at least."""
    block, size = [], 0
    for row in items.toLocalIterator():
        new = len((row["text"] or "").encode())
        if block and size + new > limit:
            yield block
            block, size = [], 0
        block.append((row["key"], row["text"]))
        size += new
    if block:
        yield block


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(key, n, terms, tfs) of every document (key, text) with a term: its number of terms,
    and of those in the vocabulary the numbers and occurrences."""
    schema = T.StructType([docs.schema["key"], T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())),
                           T.StructField("tfs", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows, n, ends, terms, tfs = [], [], [0], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    counts = Counter(terms_of(text))
                    if not counts:
                        continue
                    rows.append(i)
                    n.append(counts.total())
                    known = [(vocabulary[t], c) for t, c in counts.items() if t in vocabulary]
                    terms += [t for t, _ in known]
                    tfs += [c for _, c in known]
                    ends.append(len(terms))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column("key").take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def term_weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class ImpactLists:
    """The impact lists of a block of documents, and the way from a document into all of them."""

    def __init__(self, n: np.ndarray, first: np.ndarray, terms: np.ndarray, tfs: np.ndarray,
                 weights: np.ndarray, documents: int, length: int):
        size = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(x) * documents // length for x in n], np.int64)
        doc = np.repeat(np.arange(len(n)), np.diff(first))
        impact = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * size[doc]))
        order = np.lexsort((-impact, terms))
        self.doc, self.impact = doc[order], impact[order]
        self.begin = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        #: Of each posting, in document order: its term and its place in the lists.
        self.first, self.term = first, terms
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.unseen = np.ones(len(order), bool)
        self.met = np.zeros(len(n), bool)
        self.times = np.zeros(len(weights), np.int64)

    def access(self, docs: np.ndarray) -> np.ndarray:
        """Scores of documents; their positions in the item's lists become seen."""
        count = self.first[docs + 1] - self.first[docs]
        row = np.repeat(np.arange(len(docs)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + self.first[docs][row]
        times = self.times[self.term[at]]
        at, row, times = at[times > 0], row[times > 0], times[times > 0]
        place = self.place[at]
        self.unseen[place] = False
        score = np.zeros(len(docs), np.int64)
        np.add.at(score, row, times * self.impact[place])
        return score

    def best(self, terms: np.ndarray, times: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) with all that are among the ``top`` best of the block for an
        item and reach ``floor``, the k-th score that other blocks have (0 for none)."""
        begin, end = self.begin[terms], self.begin[terms + 1]
        terms, times, begin, end = (x[end > begin] for x in (terms, times, begin, end))
        self.times[terms] = times
        docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        leading = np.zeros(0, np.int64)
        best, read, step = begin.copy(), begin.copy(), FIRST_STEP
        while len(terms):
            upto = np.minimum(read + step, end)
            new = np.unique(np.concatenate([self.doc[a:b] for a, b in zip(read.tolist(), upto.tolist())]))
            new = new[~self.met[new]]
            self.met[new] = True
            docs.append(new)
            scores.append(self.access(new))
            leading = np.sort(np.concatenate([leading, scores[-1]]))[-top:]
            read, step = upto, 2 * step
            for i, (a, b) in enumerate(zip(best.tolist(), end.tolist())):
                ahead = self.unseen[a:b]
                run = int(ahead.argmax()) if len(ahead) else 0
                best[i] = a + run if len(ahead) and ahead[run] else b
            bound = int((times * np.where(best < end, self.impact[best - 1], 0)).sum())
            kth = max(floor, int(leading[0]) if len(leading) == top else 0)
            if bound < kth or bound == 0:
                break
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        self.times[terms] = 0
        self.met[docs] = False
        for a, b in zip(begin.tolist(), end.tolist()):
            self.unseen[a:b] = True
        least = max(floor, int(leading[0]) if len(leading) == top else 0, 1)
        return docs[scores >= least], scores[scores >= least]


def _order(row: tuple) -> tuple:
    score, key = row
    return -score, key is None, key if key is not None else 0


class _Leaders:
    """The best ``top`` rows (score, key) of each item that a task has found."""

    def __init__(self, items: Items, top: int):
        self.items, self.top = items, top
        self.rows: list[list[tuple]] = [[] for _ in items.asked]

    def search(self, keys: pa.Array, lists: ImpactLists) -> None:
        for i, (terms, times) in enumerate(self.items.asked):
            own = self.rows[i]
            floor = own[-1][0] if len(own) == self.top else 0
            docs, scores = lists.best(terms, times, self.top, floor)
            if len(docs):
                new = keys.take(pa.array(docs)).to_pylist()
                self.rows[i] = sorted([*own, *zip(scores.tolist(), new)], key=_order)[:self.top]


def search_blocks(counted: DataFrame, items: Items, weights: np.ndarray, documents: int, length: int,
                  top: int, block_postings: int) -> DataFrame:
    """(item, key, score): the best ``top`` documents of every item in every task."""
    schema = T.StructType([T.StructField("item", T.IntegerType()), counted.schema["key"],
                           T.StructField("score", T.LongType())])

    def run(batches):
        found = _Leaders(items, top)
        keys, parts, postings, kind = [], [], 0, None

        def finish():
            n, sizes, terms, tfs = (np.concatenate(x) for x in zip(*parts))
            first = np.concatenate([[0], np.cumsum(sizes)])
            found.search(pa.concat_arrays(keys), ImpactLists(n, first, terms, tfs, weights, documents, length))

        for batch in batches:
            kind = batch.schema.field("key").type
            terms, tfs = batch.column("terms"), batch.column("tfs")
            keys.append(batch.column("key"))
            parts.append((batch.column("n").to_numpy(), terms.value_lengths().to_numpy().astype(np.int64),
                          terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()))
            postings += len(parts[-1][2])
            if postings >= block_postings:
                finish()
                keys, parts, postings = [], [], 0
        if parts:
            finish()
        rows = [(i, key, score) for i, own in enumerate(found.rows) for score, key in own]
        if rows:
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind),
                pa.array([r[2] for r in rows], pa.int64())], names=schema.names)

    return counted.mapInArrow(run, schema)


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES,
    block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item with a score above 0.

    Equal scores rank by ascending document key, a null key last. Every row of ``docs``
    is a document and every row of ``items`` an item, repeated keys and texts too: an
    item that comes twice is ranked twice. Null and empty texts, and texts without a
    term, are no document and ask for nothing. Terms that no document holds add nothing.
    Without documents or items the result is empty.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    items = settle(items.select(F.col(item_key).alias("key"), F.col(item_text).alias("text")), "items")
    name = T.StructField("item_id", items.schema["key"].dataType)
    out = T.StructType([name, T.StructField("rank", T.IntegerType()),
                        T.StructField("doc_id", docs.schema["key"].dataType), T.StructField("score", T.LongType())])
    found = [spark.createDataFrame([], out)]
    for block in item_blocks(items, item_bytes):
        asked = Items([t for _, t in block])
        if not asked.vocabulary:
            continue
        counted = settle(count_terms(docs, asked.vocabulary), "counted_terms")
        documents, length = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            break
        df = np.zeros(len(asked.vocabulary), np.int64)
        for term, n in counted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            df[term] = n
        some = counted.where(F.size("terms") > 0)
        best = search_blocks(some, asked, term_weights(df, documents), documents, length, top, block_postings)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key")))
        ranked = best.withColumn("rank", rank).where(F.col("rank") <= top)
        names = spark.createDataFrame(
            [(i, k) for i, (k, _) in enumerate(block)],
            T.StructType([T.StructField("item", T.IntegerType()), name]))
        found.append(settle(ranked.join(names, "item").select(
            "item_id", "rank", F.col("key").alias("doc_id"), "score"), "ranked"))
    return union_all(found[1:] or found)


ORACLE_SQL = """
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term
    FROM documents
), counts AS (
    SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL
), lengths AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY ALL
), corpus AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM lengths
), asked AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term
        FROM benchmark) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM counts, corpus GROUP BY term
), scores AS (
    SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score
    FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus
    GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
"""
