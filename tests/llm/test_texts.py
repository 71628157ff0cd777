"""Operators on single texts against brute force: BPE, leaks, fingerprints, token files, language."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridvalue.llm import bpe, decontaminate, fingerprints, language, token_files
from gridvalue.llm.registry import QUERIES

from . import brute

DOCS = "doc_id long, text string"
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "a" * 3000), (5, "One two three four five six seven eight nine ten."),
    (6, "One two three four five six seven eight nine ten."), (6, "One two three four five six seven eight nine ten."),
    (7, "it's  a\n test, we'll <|endoftext|> see 123 漢字 😀 \x1c \x85 é"), (8, "one two"), (None, "null key one two three"),
    (9, "x ONE TWO three four five six seven eight nine TEN eleven y"), (10, "word " * 4000), (11, "­​__--'s"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def coder(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_file(ranks):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        assert len(ranks) == len(f.readlines())
    assert ranks[base64.b64decode(b"IQ==")] == 0


def test_op3_equals_library(spark, sf, documents, coder):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op3_bpe"](spark, sf).collect()}
    for d in documents:
        ids = coder.encode_ordinary(d["text"])
        assert got[d["doc_id"]] == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(d["text"].encode()).hexdigest())
    assert len(got) == len(documents)


def test_bpe_counts_words_of_all_documents(spark):
    docs = spark.range(30_000).selectExpr("concat('w', id div 2 + 10000, 'x') as text")
    assert bpe.frequent_words(docs, "text", "[a-z0-9]+").count() == 15_000
    some = docs.unionByName(docs.limit(50))
    assert bpe.frequent_words(some, "text", "[a-z0-9]+", limit=40).count() <= 40


@pytest.mark.parametrize("limit, rare", [(0, "task"), (4, "task"), (0, "spark"), (4, "spark")])
def test_bpe_odd_texts(odd, ranks, coder, limit, rare):
    """The ids do not depend on which words the broadcast holds, nor on who folds the rest."""
    made = bpe.decode(bpe.encode(
        odd.withColumn("ids", F.lit("clash")), ranks, public_tokenizers.PATTERN, limit=limit, rare=rare), ranks)
    rows = made.collect()
    assert sorted(made.columns) == ["decoded", "doc_id", "ids", "text"] and len(rows) == len(ODD)
    for r in rows:
        assert r["ids"] == coder.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_fold_of_any_bytes(ranks, coder):
    words = ["a" * 2000, "é漢" * 300, "qxzjv" * 100, "thethethe", "\u00ad", "😀" * 50]
    assert [bpe.fold_bytes(w.encode(), ranks) for w in words] == [
        coder._encode_single_piece(w) for w in words]


def test_rank_map_is_short_texts_in_a_plan_of_one_stage(spark, ranks):
    made = spark.range(1).select(bpe.rank_map(ranks).alias("pairs"))
    assert dict(made.dtypes)["pairs"] == "array<string>"
    words = spark.createDataFrame([("thatwhich",), ("thatwhich",), ("zqxj",), (None,)], "word string")
    plan, names = bpe.encode_words(words, ranks)._jdf.queryExecution().executedPlan(), []
    while True:
        names.append(plan.nodeName())
        if not plan.children().size():
            break
        plan = plan.children().apply(0)
    assert names[0] != "AdaptiveSparkPlan" and names[-1].startswith("Scan parquet")
    assert not [n for n in names if "Join" in n or "Exchange" in n]


def test_bpe_empty_table(spark, odd, ranks):
    assert bpe.round_trip_report(odd.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    words = spark.createDataFrame([("",), (None,), ("the",)], "word string")
    assert {r["word"]: r["ids"] for r in bpe.encode_words(words, ranks).collect()} == {
        "": [], None: [], "the": [ranks[b"the"]]}


def test_op6_equals_brute_force(spark, sf, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    expected = brute.leaks([tuple(d) for d in documents], items)
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op6_decontamination"](spark, sf).collect()}
    assert got == expected and any(r[4] for r in got.values())


ITEMS = [(1, "one two three four five six seven eight nine ten"), (20, "ONE TWO"), (3, None), (4, "..."), (1, "zzz")]


@pytest.mark.parametrize("block", [8 << 20, 20])
def test_leaks_odd_texts(spark, odd, block):
    """One block of the benchmark or several give the same."""
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.find_leaks(odd.withColumn("spans", F.lit(1)), bench, block_bytes=block).collect()
    for r in got:
        n, hit, _, _, _ = brute.leaks([(0, r["text"])], ITEMS)[0]
        assert r["n_words"] == n and sum(s["after"] - s["first"] for s in r["spans"]) == hit
    assert len(got) == len(ODD)


def test_leaks_are_dropped_or_cut(spark, odd):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    wide = odd.withColumns({"items": F.lit("mine"), "_x": F.lit(2)})
    kept = decontaminate.drop_contaminated(wide, bench)
    assert kept.columns == wide.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 7, 10, 11], key=str)
    cut = decontaminate.cut_contaminated(wide, bench)
    assert cut.columns == wide.columns and cut.count() == len(ODD)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[9] == "x  eleven y" and texts[6] == "." and texts[1] is None
    assert decontaminate.leak_report(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.leak_report(odd.limit(0), bench).count() == 0


def edit_rows(docs):
    rows = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""), reverse=True)
    texts = [t or "" for _, t in rows]
    for i, (key, text) in enumerate(zip([k for k, _ in rows], texts)):
        other = texts[(i + 1) % len(texts)]
        third = len(text) // 3
        yield key, text, text[:len(text) - third] + other[:third], other


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_op1_equals_brute_force(spark, sf, documents, odd, table):
    if table == "documents":
        got, docs = QUERIES["op1_fingerprints"](spark, sf).collect(), [tuple(d) for d in documents]
    else:
        got, docs = fingerprints.edit_report(odd).collect(), ODD
    expected = []
    for key, text, made, other in edit_rows(docs):
        a, b, c = fingerprints.fingerprint_texts([text, made, other])
        expected.append((key, len(text), hashlib.sha256(made.encode()).hexdigest(), a, b,
                         fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_likeness_follows_the_shared_text():
    base = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(900))
    a, same, edited, other, empty = fingerprints.fingerprint_texts([base, base, base[:600] + "9" * 300, "9" * 900, ""])
    assert a == same and fingerprints.likeness(a, same) == 1.0
    assert 0.58 < fingerprints.likeness(a, edited) <= 600 / 900
    assert fingerprints.likeness(a, other) == fingerprints.likeness(a, empty) == 0.0
    assert fingerprints.likeness(empty, empty) == 1.0


def test_common_extension(spark):
    rows = [("abcabcab", 0, "xxabcabd", 2), ("abc", 1, "abc", 1), ("abc", 3, "abc", 0), (None, 0, "a", 0), ("é😀é", 0, "😀é", 0),
            ("é😀é", 1, "😀é", 0), ("a", None, "a", 0), ("a" * 5000, 0, "a" * 4000 + "b", 1)]
    frame = spark.createDataFrame(rows, "a string, i long, b string, j long")
    got = [r["common"] for r in fingerprints.add_common_extension(frame.coalesce(1), "a", "i", "b", "j").collect()]
    assert got == [5, 2, 0, 0, 0, 2, 0, 3999]


def test_fingerprints_empty_and_single(spark, odd):
    assert fingerprints.edit_report(odd.limit(0)).count() == 0
    row = fingerprints.edit_report(odd.where("doc_id = 5")).first()
    assert row["near_next"] == 1.0 and row["n_chars"] == len(ODD[4][1])


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_op7_equals_library(spark, sf, documents, odd, table):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        json = f.read()
    if table == "documents":
        got, docs = QUERIES["op7_token_files"](spark, sf).collect(), [tuple(d) for d in documents]
    else:
        got, docs = token_files.token_report(odd, json).collect(), ODD
    expected, start = [], 0
    for key, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        expected.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_benchmark_windows_equal_brute_force():
    """Windows of many items, repeated ones and short ones among them, found in texts."""
    rng = np.random.default_rng(3)
    vocabulary = ["a", "b", "É", "12", "c-d", "_"]
    items = [(str(i % 40), " ".join(rng.choice(vocabulary, rng.integers(0, 15)))) for i in range(120)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(80)] + [t for _, t in items[:40]]

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))

    expected = {}
    for item, text in items:
        own = words(text)
        size = min(4, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            expected.setdefault(tuple(own[i:i + size]), set()).add(item)
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    built = decontaminate.WindowSet(decontaminate.hash_windows(items, 4))
    counts, found = built.scan(np.frombuffer(b"".join(raw), np.uint8), at)
    assert counts.tolist() == [len(words(t)) for t in texts]
    brute_force = [
        (t, i, size, of) for t, text in enumerate(texts) for size in (1, 2, 3, 4) for i in range(len(words(text)))
        if len(words(text)) >= i + size and (of := expected.get(tuple(words(text)[i:i + size])))]
    assert sorted(map(str, ((t, i, s, sorted(of)) for t, i, s, of in found))) == sorted(
        map(str, ((t, i, s, sorted(of)) for t, i, s, of in brute_force)))
    assert decontaminate.hash_windows([], 4)["windows"] == {}


def test_pieces_equal_library():
    """Random joins of letters, marks, spaces and odd characters, by pieces and whole; also
    with caches that forget after every text."""
    rng = np.random.default_rng(7)
    bits = ["a", "é", "ß", " ", "  ", "\n", "\n\n", "\t", ".", "...", "'", "s", "'re", "1", "_", "<|endoftext|>", "漢", "\0",
            "\x85", "I", "İ", "ſ", "\u0301", "😀", "\r\n", "ª", "²", "٣", "word", "Bar", " \n", "’", "\x1c", "$$$"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(20_000)]
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = token_files.Encoder(f.read())
    expected = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.by_piece and encoder.encode(texts) == expected
    size, token_files.CACHED_PIECES = token_files.CACHED_PIECES, 0
    try:
        assert encoder.encode(texts) == expected
    finally:
        token_files.CACHED_PIECES = size


def test_token_files_read_selectively(spark, odd, tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        token_files.write_token_files(odd, str(tmp_path / "t"), f.read())
    plan = token_files.read_tokens(spark, str(tmp_path / "t"), ids=False)
    assert "ids" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == len(ODD)
    token_files.write_token_files(odd.limit(0), str(tmp_path / "e"), "".join(open(public_tokenizers.path("byte_bpe_50k.json"))))
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_op10_held_out_accuracy(spark, sf):
    got = QUERIES["op10_language"](spark, sf)
    labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(labels, "doc_id").collect()
    assert len(rows) == labels.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert sum(held) / len(held) > 0.95


def test_language_odd_texts(spark, odd):
    train = spark.createDataFrame(
        [("the cat and the dog are here " * 3, "en"), ("der hund und die katze sind hier " * 3, "de"), (None, "en"), ("x", None),
         ("", "fr")], "text string, lang string")
    model = language.fit(train)
    rows = language.add_language(odd.withColumn("score", F.lit("mine")), model, prefix="p_").collect()
    assert len(rows) == len(ODD) and rows[0]["score"] == "mine"
    by = {r["text"]: r for r in rows}
    for text in (None, "", "  \n\t "):
        assert by[text]["p_lang_pred"] == "und" and by[text]["p_rejected"] and by[text]["p_score"] == 0
    assert by["one two"]["p_lang_pred"] in ("en", "de")
    assert language.add_language(odd.limit(0), model).count() == 0
    none = language.add_language(odd, language.fit(train.limit(0)), prefix="p_")
    assert {r["p_lang_pred"] for r in none.collect()} == {"und"}
    far = language.add_language(spark.createDataFrame([("漢字仮名交じり文",)], "text string"), model).first()
    assert far["rejected"]
