"""The filter audit against applying every order, document by document."""

import itertools
import random
import re

from pyspark.sql import functions as F

from gridvalue.llm import filter_audit


def failures(docs):
    """The set of failing letters of each (key, lang, text)."""
    out = []
    for key, _, text in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": key is not None and any(k is not None and k < key and (t or "") == text for k, _, t in docs)}
        out.append({c for c, f in fails.items() if f})
    return out


def brute(docs, labels, letters="ABCDE"):
    fails = failures(docs)
    good = {k for k, q, _ in labels if q == 1}
    toxic = {k for k, _, t in labels if t == 1}
    out = {}
    for part in {lang or "" for _, lang, _ in docs}:
        own = [(k, f) for (k, lang, _), f in zip(docs, fails) if (lang or "") == part]
        shapley = dict.fromkeys(letters, 0)
        for order in itertools.permutations(letters):
            left = own
            for step, c in enumerate(order):
                removed = [(k, f) for k, f in left if c in f]
                shapley[c] += len(removed)
                lost = len([1 for _, f in own if c in f]) - len(removed)
                left = [x for x in left if c not in x[1]]
                out[part, "".join(order), step + 1] = [
                    len(left), len(removed), lost, len([1 for _, f in own if f == {c}]),
                    len([1 for k, _ in removed if k is not None and k in good]),
                    len([1 for k, _ in removed if k is not None and k in toxic])]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def rows(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


def odd_documents():
    rng = random.Random(3)
    names = [f"w{i}" for i in range(400)]
    docs = [(1, None, None), (2, "en", ""), (3, "en", None), (4, "de", " \t"), (None, "en", "copy me"), (6, "en", "copy me"),
            (None, "en", "copy me"), (7, "de", "copy me"), (7, "de", "copy me"), (7, "de", "other text"),
            (8, "fr", "UP " * 300), (9, "fr", "long " * 40_000), (10, "fr", "long " * 40_000 + "$")]
    for i in range(60):
        words = rng.choices(names, k=rng.choice([50, 250, 300]))
        text = " ".join(words) + rng.choice(["", " 100%", " AAA" * 30])
        docs.append((20 + i, rng.choice(["en", "de", None]), text))
        if rng.random() < 0.4:
            docs.append((100 + i, rng.choice(["en", "de"]), text))
    labels = [(1, 1, 0), (6, 1, 1), (7, 0, 1), (7, 1, None), (99, 1, 1), (None, 1, 1), *[(20 + i, i % 2, i % 3) for i in range(60)]]
    return docs, labels


def test_audit_equals_every_order(spark):
    docs, labels = odd_documents()
    frame = spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumns(
        {c: F.lit(7) for c in ("key", "part", "hash", "mask", "n", "good", "toxic", "bit", "least")})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("key", F.lit("x"))
    got = filter_audit.audit(frame, known)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                           "toxic_lost", "shapley"]
    assert rows(got) == brute(docs, labels)


def test_copies_of_one_text_and_other_filters(spark):
    docs = [(i, "en", "same") for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    known = spark.createDataFrame([(0, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    got = rows(filter_audit.audit(frame, known, {"S": F.col("text").contains("am")}))
    assert got == {("en", "SE", 1): (0, 3000, 0, 1, 2, 1, 3000 + 1), ("en", "SE", 2): (0, 0, 2999, 0, 0, 0, 2999),
                   ("en", "ES", 1): (1, 2999, 0, 0, 1, 1, 2999), ("en", "ES", 2): (0, 1, 2999, 1, 1, 0, 3001)}
    alone = rows(filter_audit.audit(frame, known, {"S": F.col("text").contains("z")}, copies=None))
    assert alone == {("en", "S", 1): (3000, 0, 0, 0, 0, 0, 0)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, known).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    got = rows(filter_audit.audit(one, known))
    assert got == brute([(1, None, None)], []) and len(got) == 600
