"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Every window of ten consecutive words of a benchmark item (or the whole item, if
it is shorter) is hashed, all at once over the joined texts, and the sorted hashes
are broadcast. Tasks scan all word windows of their texts against them, compare the
words of every candidate exactly, and mark the words that a verified window covers.
The benchmark is a stated query set. It is broadcast in blocks of about
``block_bytes`` of text (at most some 13 times that in arrays), of which the driver
holds one at a time; each is one more pass over the texts, which keeps its block in
its own worker. The documents are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_by_slice, empty_if_null, free_prefix, text_column
from .words import LOWER, Hasher, find_words

WINDOW = 10
BLOCK_BYTES = 8 << 20

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

SPAN = T.StructType([T.StructField("first", T.LongType()), T.StructField("after", T.LongType())])


def hash_windows(items: list[tuple[str, str]], window: int) -> dict:
    """Arrays of a block of items: their lower-cased bytes, words, and by number of words
    the sorted hashes of all windows with the words that these begin at."""
    raw = [text.encode() for _, text in items]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)
    data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    starts, ends, first = find_words(data, at, IS_WORD)
    hasher, counts, by_size = Hasher(), np.diff(first), {}
    prefix = hasher.prefix(hasher.of_words(data, starts, ends))
    sizes = np.minimum(counts, window)
    for size in np.unique(sizes[sizes > 0]).tolist():
        # An item has as many windows as its words allow; a shorter one is one window.
        rows = np.flatnonzero(sizes == size)
        each = counts[rows] - size + 1
        words = np.repeat(first[rows] - np.cumsum(each) + each, each) + np.arange(each.sum())
        hashes = hasher.of_runs(prefix, size)[words]
        order = np.argsort(hashes, kind="stable")
        by_size[size] = hashes[order], words[order].astype(np.uint32)
    return {"ids": [i for i, _ in items], "data": data.tobytes(), "starts": starts.astype(np.uint32),
            "ends": ends.astype(np.uint32), "first": first, "windows": by_size}


class WindowSet:
    """Search in the arrays of ``hash_windows``."""

    def __init__(self, block: dict):
        self.block, self.hasher = block, Hasher()
        self.hashes = {size: hashes for size, (hashes, _) in block["windows"].items()}
        self.maps = {}
        for size, hashes in self.hashes.items():
            self.maps[size] = np.zeros(1 << 20, bool)
            self.maps[size][hashes >> np.uint64(44)] = True
        #: Items by words, of the hashes that texts have met so far.
        self.met: dict[tuple[int, int], dict[bytes, set[str]]] = {}

    def _items(self, size: int, value: np.uint64) -> dict[bytes, set[str]]:
        """Items by the words of their windows with this hash."""
        key = size, int(value)
        if key not in self.met:
            hashes, words = self.block["windows"][size]
            lo, hi = (int(np.searchsorted(hashes, value, side)) for side in ("left", "right"))
            out: dict[bytes, set[str]] = {}
            own = words[lo:hi].astype(np.int64)
            rows = np.searchsorted(self.block["first"], own, "right") - 1
            for w, row in zip(own.tolist(), rows.tolist()):
                spans = zip(self.block["starts"][w:w + size].tolist(), self.block["ends"][w:w + size].tolist())
                text = b" ".join(self.block["data"][s:e] for s, e in spans)
                out.setdefault(text, set()).add(self.block["ids"][row])
            self.met[key] = out
        return self.met[key]

    def scan(self, data: np.ndarray, at: np.ndarray):
        """Words per text, and verified windows: (text, first word, words, items)."""
        data = LOWER[data]
        starts, ends, first = find_words(data, at, IS_WORD)
        prefix = self.hasher.prefix(self.hasher.of_words(data, starts, ends))
        raw, found = data.tobytes(), []
        for size, hashes in self.hashes.items():
            runs = self.hasher.of_runs(prefix, size)
            maybe = np.flatnonzero(self.maps[size][runs >> np.uint64(44)])
            near = np.searchsorted(hashes, runs[maybe])
            maybe = maybe[hashes[np.minimum(near, len(hashes) - 1)] == runs[maybe]]
            text = np.searchsorted(first, maybe, "right") - 1
            whole = maybe + size <= first[text + 1]
            for t, w in zip(text[whole].tolist(), maybe[whole].tolist()):
                key = b" ".join(raw[s:e] for s, e in zip(starts[w:w + size], ends[w:w + size]))
                items = self._items(size, runs[w]).get(key)
                if items:
                    found.append((t, w - int(first[t]), size, items))
        return np.diff(first), found


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, after in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], after)
        else:
            out.append([first, after])
    return [tuple(x) for x in out]


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """The benchmark's items in blocks of about ``block_bytes``, one block at a time."""
    own = benchmark.select(F.col(item).cast("string").alias("i"), empty_if_null(F.col(text)).alias("t"))
    size = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    for k in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"] if r["i"] is not None else "", r["t"]) for r in part.collect()]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, prefix: str = "",
) -> DataFrame:
    """Add ``n_words``, ``spans`` (merged word ranges that windows cover) and
    ``items`` (ids, as strings, of the items that occur) to every document.

    A null text has no words. An empty benchmark, or items without words, match
    nothing. Repeated items count by their ids; a null id reads as the empty
    string. Rows and other columns stay; the new names take ``prefix``, and columns
    that have them are replaced.
    """
    count, span, hit = (f"{prefix}{n}" for n in ("n_words", "spans", "items"))
    fields = {count: T.LongType(), span: T.ArrayType(SPAN), hit: T.ArrayType(T.StringType())}
    out, first_block = docs, True
    for block in benchmark_blocks(benchmark, item, item_text, block_bytes):
        made, shared = {}, docs.sparkSession.sparkContext.broadcast(hash_windows(block, window))

        def scan(batch, shared=shared, made=made, first_block=first_block):
            if "set" not in made:
                made["set"] = WindowSet(shared.value)
            data, at = text_column(batch.column(text))
            counts, found = made["set"].scan(data, at)
            spans = [set() for _ in range(batch.num_rows)]
            items = [set() for _ in range(batch.num_rows)]
            if not first_block:
                for row, s in enumerate(batch.column(span).to_pylist()):
                    spans[row] |= {(x["first"], x["after"]) for x in s}
                for row, s in enumerate(batch.column(hit).to_pylist()):
                    items[row] |= set(s)
            for t, w, size, of in found:
                spans[t].add((w, w + size))
                items[t] |= of
            kind = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
            return {
                count: pa.array(counts, pa.int64()),
                span: pa.array([[{"first": a, "after": b} for a, b in merge_spans(s)] for s in spans], kind),
                hit: pa.array([sorted(s) for s in items], pa.list_(pa.string())),
            }

        out = add_by_slice(out, text, scan, fields)
        first_block = False
    return out


def leak_report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: words, hit words, items that occur, and their digest."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    return find_leaks(docs.select(key, text), benchmark, text).select(
        key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Documents without any benchmark window; every other document goes as a whole."""
    p = free_prefix(docs)
    found = find_leaks(docs, benchmark, text, prefix=p)
    return found.where(F.size(f"{p}items") == 0).select(*docs.columns)


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """All documents, with their hit words, and what lies between these, cut from the text."""
    p = free_prefix(docs)

    def cut(batch):
        texts = []
        for value, spans in zip(batch.column(text).to_pylist(), batch.column(f"{p}spans").to_pylist()):
            if spans:
                raw, pieces, done = value.encode(), [], 0
                data = LOWER[np.frombuffer(raw, np.uint8)]
                starts, ends, _ = find_words(data, np.array([0, len(data)]), IS_WORD)
                for s in spans:
                    pieces.append(raw[done:starts[s["first"]]])
                    done = ends[s["after"] - 1]
                value = b"".join([*pieces, raw[done:]]).decode()
            texts.append(value)
        return {text: pa.array(texts, pa.string())}

    found = find_leaks(docs, benchmark, text, prefix=p)
    return add_by_slice(found, text, cut, {text: T.StringType()}).select(*docs.columns)
