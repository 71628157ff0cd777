"""Ranked search against a plain scan of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridvalue.llm import ranked_search


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def scan(docs, items, top=10):
    """[(item, rank, doc, score)] by scoring every document for every item."""
    counted = [(k, Counter(words(t))) for k, t in docs if words(t)]
    n_docs, length = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in counted:
            m = 25 + 75 * c.total() * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if score > 0:
                scored.append((-score, key is None, key))
        scored.sort(key=lambda r: (r[0], r[1], r[2] if r[2] is not None else 0))
        out += [(item, i + 1, key, -s) for i, (s, _, key) in enumerate(scored[:top])]
    return out


def run(spark, docs, items, doc_key="long", **options):
    d = spark.createDataFrame(docs, f"doc_id {doc_key}, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = ranked_search.search(d, i, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def random_texts(seed, n, vocabulary=60, length=30):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)] + ["É", "Straße", "中文"]
    weights = [1 / (i + 1) for i in range(len(names))]
    return [" ".join(rng.choices(names, weights, k=rng.randint(1, length))) for _ in range(n)]


@pytest.mark.parametrize("block", [40, 500, 1 << 21])
def test_blocks_of_any_size_give_the_scan(spark, block):
    docs = list(enumerate(random_texts(1, 300)))
    items = list(enumerate(random_texts(2, 25, length=12)))
    got = run(spark, docs, items, block_postings=block)
    assert got == sorted(scan(docs, items), key=repr) and len(got) > 200


def test_blocks_of_items(spark):
    docs = list(enumerate(random_texts(3, 80)))
    items = list(enumerate(random_texts(4, 12, length=8)))
    assert run(spark, docs, items, item_bytes=30) == run(spark, docs, items) == sorted(scan(docs, items), key=repr)


def test_odd_texts_ties_and_repeats(spark):
    long = "needle " + "hay " * 50_000 + "needle"
    docs = [(5, None), (6, ""), (7, " \t--"), (8, "Needle in HAY"), (9, "needle in hay"), (9, "needle in hay"),
            (None, "needle in hay"), (3, long), (4, "x" * 30_000), *[(100 + i, "common words here") for i in range(40)]]
    items = [(1, "needle hay needle"), (1, "common"), (2, None), (3, ""), (4, "absent"), (None, "x" * 30_000), (5, "-- !")]
    got = run(spark, docs, items)
    assert got == sorted(scan(docs, items), key=repr)
    tied = [r[2] for r in sorted(got, key=lambda r: r[1]) if r[0] == 1 and r[3] == scan(docs, [(1, "common")])[0][3]]
    assert tied == list(range(100, 110))


def test_keys_of_text_and_clashing_names(spark):
    docs = [(f"k{i}", t) for i, t in enumerate(random_texts(5, 60))]
    items = list(enumerate(random_texts(6, 5)))
    d = spark.createDataFrame(docs, "doc_id string, text string").withColumns(
        {c: F.lit("mine") for c in ("key", "n", "terms", "tfs", "item", "rank", "score", "item_id")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns(
        {c: F.lit(1) for c in ("key", "item", "rank", "doc_id")})
    got = sorted(map(tuple, ranked_search.search(d, i).collect()), key=repr)
    assert got == sorted(scan(docs, items), key=repr)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "word")]) == run(spark, [(1, "word")], []) == run(spark, [(1, None)], [(1, "word")]) == []


def test_lists_are_left_early():
    """Where few documents hold the rare terms, most of a frequent term's list stays unread."""
    rng = np.random.default_rng(1)
    n = 5000
    sizes = np.where(np.arange(n) < 20, 3, 1)
    terms = np.concatenate([[0, 1, 2] if s == 3 else [0] for s in sizes])
    lists = ranked_search.ImpactLists(
        rng.integers(5, 50, n), np.concatenate([[0], np.cumsum(sizes)]), terms, rng.integers(1, 4, len(terms)),
        np.array([1, 5000, 5000]), n, n * 20)
    read = []
    lists.access, plain = lambda d: read.append(len(d)) or plain(d), lists.access
    docs, scores = lists.best(np.arange(3), np.ones(3, np.int64), 10, 0)
    every = plain_scores(lists, n)
    kth = np.sort(every)[-10]
    assert sum(read) < n / 10 and sorted(docs.tolist()) == np.flatnonzero(every >= kth).tolist()
    assert (every[docs] == scores).all() and lists.unseen.all() and not lists.met.any()


def plain_scores(lists, n):
    out = np.zeros(n, np.int64)
    np.add.at(out, lists.doc, lists.impact)
    return out
