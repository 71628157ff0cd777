"""Byte-level BPE: ranked merges folded by Spark's higher-order functions.

A word is a match of the split pattern. Its bytes are written as a string with one
character a piece (the character of an id is a fixed distance above it), and a fold
merges, again and again, the adjacent pair with the lowest rank, leftmost first. The
rank map is a constant of the plan: an array of short texts, each a list of (pair, merged
piece), at the hash of the pair, so a look-up searches one of them.

Frequent distinct words are folded once, as a table, and their ids go to the tasks as
a broadcast of bounded size (``CACHED_WORDS``). Tasks look the words of their texts up
in it. Those it lacks are folded where they stand: by the same expression (``rare`` =
"spark"), or, as the expression takes some ten times as long as the limits allow, by
the same merges in the task's Python, each distinct word once ("task", the default).
So nothing but the counts of words is shuffled, and the ids do not depend on which words
the broadcast holds. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import settle
from .common import add_by_slice, free_prefix, give_back
from .token_files import worker_state

#: Words that the broadcast may hold.
CACHED_WORDS = 1 << 16
#: Further words whose ids a Python worker keeps.
FOLDED_WORDS = 1 << 16
#: Texts of some pairs each: every text is an object of the plan and of the tasks.
_MAPS = 1 << 15
#: The character of id 0, and what follows the pieces once no pair merges.
_FIRST = 0x10000
_DONE = "."
#: What stands before a pair in the rank map, and above all pieces where no pair merges.
_PAIR = "."
_NONE = chr(0x10FFFF)


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes and rank, which is the id, of each line of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _hash(key: str) -> int:
    """What Spark's xxhash64 gives for a string, unsigned."""
    return xxhash.xxh64_intdigest(key.encode(), 42)


def _let(value: Column, body) -> Column:
    """``body`` with a name for ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _char(i: int) -> str:
    return chr(_FIRST + i)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The merged piece of every pair of pieces whose bytes together have a rank, which
    is the merged id. Pieces are characters."""
    maps = [""] * _MAPS
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                pair = _char(left) + _char(right)
                maps[_hash(pair) & (_MAPS - 1)] += _PAIR + pair + _char(rank)
    return F.split(F.lit("\n".join(maps)), "\n")


def fold_word(pairs: Column, ranks: dict[bytes, int], word: Column) -> Column:
    """Ids of a word of one byte or more that is no piece as a whole.

    ``pairs`` is :func:`rank_map`.
    """
    every = "".join(map(chr, range(256)))
    single = "".join(_char(ranks[bytes([b])]) for b in range(256))
    pieces = F.translate(F.decode(word.cast("binary"), "ISO-8859-1"), every, single)

    def merged(pair):
        near = F.get(pairs, F.xxhash64(pair).bitwiseAND(F.lit(_MAPS - 1)).cast("int"))
        after = F.split_part(near, F.concat(F.lit(_PAIR), pair), F.lit(2))
        return F.substring(F.concat(after, F.lit(_NONE)), 1, 1)

    def merge(s, found):
        return _let(F.array_min(found), lambda best: F.when(best == _NONE, F.concat(s, F.lit(_DONE))).otherwise(
            _let(F.array_position(found, best).cast("int"), lambda k: F.concat(
                F.substring(s, F.lit(1), k - 1), best, F.substring(s, k + 2, F.length(s))))))

    def step(s, _):
        near = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))
        over = (F.length(s) < 2) | s.endswith(F.lit(_DONE))
        return F.when(over, s).otherwise(_let(F.transform(near, merged), lambda f: merge(s, f)))

    def ids(s):
        s = F.rtrim(s, F.lit(_DONE))
        return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.ascii(F.substring(s, i, F.lit(1))) - F.lit(_FIRST))

    return F.aggregate(F.sequence(F.lit(1), F.length(pieces)), pieces, step, ids)


def words_of(text: Column, pattern: str) -> Column:
    """All matches of the pattern; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def _as_text(ranks: dict[bytes, int]) -> dict[str, int]:
    """The pieces that are whole characters; no word is part of one."""
    out = {}
    for piece, rank in ranks.items():
        try:
            out[piece.decode()] = rank
        except UnicodeDecodeError:
            continue
    return out


def encode_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word", out: str = "ids",
                 pairs: Column | None = None) -> DataFrame:
    """(word, ids) of a table of distinct words. The null and the empty word have none."""
    pairs = rank_map(ranks) if pairs is None else pairs
    whole = words.sparkSession.createDataFrame(list(_as_text(ranks).items()), "piece string, rank int")
    own = words.select(F.col(word).alias("word")).join(whole, F.col("word") == F.col("piece"), "left")
    # Written, so that the plan with the rank map has a single stage: adaptive execution plans,
    # prints and serializes the map anew for each, all of it in the driver.
    own = settle(own.select("word", "rank"), "words")
    folded = _let(pairs, lambda p: fold_word(p, ranks, F.col("word")))
    none = F.array().cast("array<int>")
    return own.select(F.col("word").alias(word), F.when(F.coalesce("word", F.lit("")) == "", none).when(
        F.col("rank").isNotNull(), F.array("rank")).otherwise(folded).alias(out))


def frequent_words(docs: DataFrame, text: str, pattern: str, limit: int = CACHED_WORDS) -> DataFrame:
    """(word): at most ``limit`` words, those with the highest counts in all documents, of
    under 256 bytes and found more than once. They only save folding."""
    counts = docs.select(F.explode(words_of(F.col(text), pattern)).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.octet_length("word") < 256))
    counts = settle(counts, "word_counts")
    least, have = 2, 0
    # Each count has a word or more, so no more counts than words are needed.
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(limit + 1).collect():
        have += r["words"]
        if have > limit:
            least = r["n"] + 1
            break
    return counts.where(F.col("n") >= least).select("word")


def fold_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: merges by rank, leftmost first, in n log n steps for n bytes."""
    n, start = len(word), 0
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    if word in ranks:
        return [ranks[word]]
    while heap:
        _, i, e = heapq.heappop(heap)
        m = end[i]
        if not m or m == n or end[m] != e:
            continue  # one of the two has merged with another
        end[i], end[m] = e, 0
        if e < n:
            before[e] = i
            if (r := ranks.get(word[i:end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if i and (r := ranks.get(word[before[i]:e])) is not None:
            heapq.heappush(heap, (r, before[i], e))
    out = []
    while start < n:
        out.append(ranks[word[start:end[start]]])
        start = end[start]
    return out


class Splitter:
    """Words of texts, with their ids where the broadcast has them."""

    def __init__(self, pattern: str, ranks: dict[bytes, int], known: bytes):
        self.find, self.ranks = regex.compile(pattern).findall, ranks
        self.folded: dict[str, bytes] = {}
        rows = pa.ipc.open_stream(known).read_all().combine_chunks()
        self.known = {}
        for batch in rows.to_batches():
            values, at = _flat(batch.column("ids"))
            raw = values.to_numpy().astype("<i4").tobytes()
            self.known.update(zip(batch.column("word").to_pylist(), (
                raw[4 * s:4 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist()))))
        for piece, rank in _as_text(ranks).items():
            self.known[piece] = np.array([rank], "<i4").tobytes()

    def split(self, text: str) -> tuple[bytes, list[str]]:
        """Ids, -1 in place of each word that is not known, and these words in turn."""
        words = self.find(text)
        ids = list(map(self.known.get, words))
        if None not in ids:
            return b"".join(ids), []
        rare, at = [], -1
        for _ in range(ids.count(None)):
            at = ids.index(None, at + 1)
            rare.append(words[at])
            ids[at] = _RARE
        return b"".join(ids), rare

    def encode(self, text: str) -> bytes:
        """Ids, folding the words that are not known."""
        words = self.find(text)
        ids, at = list(map(self.known.get, words)), -1
        for _ in range(ids.count(None)):
            at = ids.index(None, at + 1)
            found = self.folded.get(words[at])
            if found is None:
                found = np.array(fold_bytes(words[at].encode(), self.ranks), "<i4").tobytes()
                if len(self.folded) >= FOLDED_WORDS:
                    self.folded.clear()
                self.folded[words[at]] = found
            ids[at] = found
        return b"".join(ids)


_RARE = np.array([-1], "<i4").tobytes()


def _lists(parts: list[bytes]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    if not len(lists):
        return lists.values.slice(0, 0), np.zeros(1, np.int64)
    at = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(at[0], at[-1] - at[0])
    return values, at - at[0]


def _put_in(open_ids: pa.Array, rare_ids: pa.Array) -> pa.Array:
    """Replace each -1 by the ids of the next rare word."""
    values, at = _flat(open_ids)
    values = values.to_numpy(zero_copy_only=False)
    inner, _ = _flat(rare_ids)
    filler, edges = _flat(inner)
    filler = filler.to_numpy(zero_copy_only=False)
    gap = values < 0
    size = np.ones(len(values), np.int64)
    size[gap] = np.diff(edges)
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, np.int32)
    out[(end - 1)[~gap]] = values[~gap]
    filled = np.ones(len(out), bool)
    filled[(end - 1)[~gap]] = False
    out[filled] = filler
    starts = np.concatenate([[0], end])[at]
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(out))


@contextmanager
def _short_plans(spark: SparkSession, characters: int = 20_000):
    """Bounds the plan texts that the driver keeps: each would spell out the rank map."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name)
    spark.conf.set(name, characters)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids",
           limit: int = CACHED_WORDS, rare: str = "task") -> DataFrame:
    """Add the ids of each whole text, as an array of ints; a null text has none.

    No special tokens. Every match of the pattern is encoded by itself; characters that
    it does not match are not encoded. A column named ``out`` is replaced.
    """
    pairs = rank_map(ranks)
    with _short_plans(docs.sparkSession):
        known = encode_words(frequent_words(docs, text, pattern, limit), ranks, pairs=pairs).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.schema) as stream:
        stream.write_table(known)
    shared = docs.sparkSession.sparkContext.broadcast((pattern, ranks, sink.getvalue().to_pybytes()))
    p = free_prefix(docs)
    name = f"splitter-{shared._jbroadcast.id()}-{docs.sparkSession.sparkContext.applicationId}"

    numbers = T.ArrayType(T.IntegerType())

    def splitter() -> Splitter:
        held = worker_state("splitter", dict)
        if name not in held:
            held.clear()
            held[name] = Splitter(*shared.value)
        return held[name]

    if rare == "task":
        def whole(batch):
            one = splitter()
            return {out: _lists([one.encode(t or "") for t in batch.column(text).to_pylist()])}

        return add_by_slice(docs, text, whole, {out: numbers})

    def split(batch):
        one = splitter()
        found = [one.split(t or "") for t in batch.column(text).to_pylist()]
        return {f"{p}open": _lists([f[0] for f in found]),
                f"{p}rare": pa.array([f[1] for f in found], pa.list_(pa.string()))}

    opened = add_by_slice(docs, text, split, {f"{p}open": numbers, f"{p}rare": T.ArrayType(T.StringType())})
    folded = _let(pairs, lambda m: F.transform(f"{p}rare", lambda w: fold_word(m, ranks, w)))
    opened = opened.withColumn(f"{p}rare", folded)
    kept = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, numbers)])
    names = [f.name for f in kept]

    def put_in(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), _put_in(batch.column(f"{p}open"), batch.column(f"{p}rare"))],
                names=[*names, out])

    return opened.mapInArrow(put_in, schema)


def _pieces(ranks: dict[bytes, int]) -> list[bytes]:
    out: list = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the concatenated bytes of the ids as a binary column.

    A null array, like an empty one, gives no bytes; an id without bytes is an error.
    """
    pieces = _pieces(ranks)
    kept = [f for f in tokens.schema.fields if f.name != out]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            texts = [b"".join([pieces[i] for i in row or ()]) for row in _rows(batch.column(ids))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(texts, pa.binary())], names=[*names, out])

    return tokens.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.BinaryType())]))


def _rows(lists: pa.Array):
    """Python lists of a list column, one at a time."""
    for row in lists:
        yield row.values.to_numpy(zero_copy_only=False).tolist() if row.is_valid else None


def round_trip(tokens: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document the number and digest of its ids and the digest of their bytes."""
    pieces, kinds = _pieces(ranks), dict(tokens.dtypes)
    numbers = [str(i) for i in range(len(pieces))]
    kept = [key, *keep]

    def run(batches):
        for batch in batches:
            sizes, ids, texts = [], [], []
            for row in _rows(batch.column("ids")):  # one at a time: lists take ten times the room
                row = row or []
                sizes.append(len(row))
                ids.append(hashlib.sha256(" ".join(map(numbers.__getitem__, row)).encode()).hexdigest())
                texts.append(hashlib.sha256(b"".join(map(pieces.__getitem__, row))).hexdigest())
            yield pa.RecordBatch.from_arrays([
                *(batch.column(k) for k in kept), pa.array(sizes, pa.int64()),
                pa.array(ids, pa.string()), pa.array(texts, pa.string()),
            ], names=[*kept, "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    fields = [f"`{k}` {kinds[k]}" for k in kept]
    return tokens.select(*dict.fromkeys([*kept, "ids"])).mapInArrow(
        run, ", ".join([*fields, "n_tokens long, ids_sha256 string, decoded_sha256 string"]))


def round_trip_report(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids, and report on both."""
    return round_trip(encode(docs.select(key, text), ranks, pattern, text), ranks, key)
