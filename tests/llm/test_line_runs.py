"""Line deduplication against a plain pass in key order."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gridvalue.llm import line_runs


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))


def brute(docs, least=10):
    """[(key, n_lines, n_dropped, kept)] of (key, text); a null key is the largest."""
    holder = {}
    for key, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        for line in (text or "").split("\n"):
            holder.setdefault(key_of(line), key)
    out = []
    for key, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < least or holder[key_of(x)] == key]
        out.append((key, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def report(docs):
    return sorted([(k, n, d, hashlib.sha256(t.encode()).hexdigest()) for k, n, d, t in brute(docs)], key=repr)


def odd_documents():
    rng = random.Random(5)
    lines = [f"line number {i} of the pool" for i in range(120)] + ["short", "", "  ", "Äußere Zeile mit UMLAUT", "ÄUSSERE zeile"]
    docs = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 12)))) for i in range(200)]
    return docs + [
        (500, None), (501, ""), (502, "\n\n"), (503, "\tLine Number 3 OF the pool \r"), (504, "line number 3 of the pool\x0b"),
        (505, " line number 3 of the pool"), (506, "äußere zeile mit umlaut"), (507, "Äußere Zeile mit umlaut\nÄußere zeile mit UMLAUT"),
        (508, "only ten!!"), (509, "ONLY ten!!"), (510, "only nin!"), (511, "only nin!"),
        (512, "twice in one document\ntwice in one document"), (513, "twice in one document\nnew in this document"),
        (514, "one key, two rows"), (514, "one key, two rows\nand one line more"), (515, "one key, two rows"), (515, "one key, two rows"),
        (None, "without a key at all"), (None, "without a key at all\nline number 3 of the pool"), (516, "x" * 200_000), (517, "X" * 200_000),
        (518, "\n".join(f"line number {i % 130} of the pool" for i in range(20_000)))]


@pytest.mark.parametrize("batches, fanout", [(1, 3), (6, 3), (9, 2)])
def test_lines_equal_one_pass(spark, batches, fanout):
    docs = odd_documents()
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {c: F.lit(4) for c in ("key", "mark", "pos", "h1", "batch", "_key", "n_lines")})
    got = line_runs.line_report(frame, batches=batches, fanout=fanout)
    assert sorted(map(tuple, got.collect()), key=repr) == report(docs)


def test_texts_lose_their_lines(spark):
    docs = odd_documents()
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("more", F.lit(1))
    out = line_runs.drop_repeated_lines(frame, batches=4)
    assert out.columns == frame.columns
    expected = {(k, t) for k, _, _, t in brute(docs)} - {(500, "")} | {(500, None)}
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == expected and out.count() == len(docs)


def test_runs_grow_by_batch_and_are_merged(spark):
    """Batches that come one by one; earlier ones come first whatever their keys."""
    state = line_runs.LineRuns(spark, fanout=2, buckets=4)
    batches = [[(9, "first line of all\nshared by many docs")], [(1, "shared by many docs\nnew in batch two")],
               [(2, "new in batch two"), (3, "new in batch three"), (4, "NEW in batch three")], [], [(5, "first line of all")]]
    dropped, shape = [], []
    for rows in batches:
        lines = line_runs.line_hashes(spark.createDataFrame(rows, "key long, text string"))
        dropped.append(sorted((r["key"], r["pos"]) for r in state.add(lines).collect()))
        shape.append([len(level) for level in state.levels])
    assert dropped == [[], [(1, 0)], [(2, 0), (4, 0)], [], [(5, 0)]]
    assert shape == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    table = state.levels[2][0].table
    assert table.count() == 4 and table.select("h1", "h2").distinct().count() == 4
    merged = table.join(table.withColumnRenamed("first", "f").hint("merge"), ["h1", "h2"], "left_anti")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan and "Exchange" not in plan
    names = [r.name for r in state.runs()]
    state.clear()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_keys_of_text_and_empty_tables(spark):
    docs = [(f"k{i:02}", f"a line that all have\nline of its own {i}") for i in range(30)]
    got = line_runs.line_report(spark.createDataFrame(docs, "doc_id string, text string"), batches=5)
    assert {(r["doc_id"], r["n_dropped"]) for r in got.collect()} == {(k, int(k != "k00")) for k, _ in docs}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_runs.line_report(none).count() == 0 and line_runs.drop_repeated_lines(none).count() == 0


def test_main_path_is_native(spark):
    docs = spark.createDataFrame(odd_documents(), "doc_id long, text string")
    plan = line_runs.line_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
