"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has a bit set where over half of the hashes of a text's word
shingles have it. Distinct fingerprints are put into tiles by the population counts
of their four 16-bit quarters: two fingerprints within a radius differ, summed over
the quarters, by at most that radius in these counts, so tile pairs beyond it are
skipped and no link is lost. Within a tile pair numpy compares everything with
exclusive-or and bit counts, a block of ``BLOCK`` rows of the tile against a stream
of the rows that visit it; a large tile is many blocks. Of the links between a
block and its visitors only a spanning forest leaves the task.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import join_side, settle
from .common import add_by_slice, drop_worker_state, free_prefix, give_back, text_column
from .components import component_roots
from .words import LOWER, find_words

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCK = 4096
QUARTERS = 4

#: Bytes of words [^\x20\x09-\x0D]+.
IS_WORD = np.ones(256, bool)
IS_WORD[0x20] = IS_WORD[0x09:0x0E] = False


def fingerprints_of(data: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text of a buffer; 0 for a text without words."""
    data = LOWER[data]
    starts, ends, first = find_words(data, at, IS_WORD)
    n = np.diff(first)
    # Words back to back with one space after each.
    sizes = ends - starts
    put = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat = np.full(int(put[-1]), 0x20, np.uint8)
    inside = np.ones(len(flat), bool)
    inside[put[1:] - 1] = False
    flat[inside] = data[IS_WORD[data]]
    width = np.minimum(n, shingle)
    counts = np.where(n > 0, n - width + 1, 0)
    text = np.repeat(np.arange(len(n)), counts)
    row = np.concatenate([[0], np.cumsum(counts)])
    word = first[text] + np.arange(len(text)) - row[text]
    begin, end = put[word], put[word + width[text]] - 1
    raw, digest = flat.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(raw[b:e], SEED) for b, e in zip(begin.tolist(), end.tolist())), np.uint64, len(begin))
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total = np.add.reduceat(bits, row[some], axis=0, dtype=np.int64)
        out[some] = np.where(2 * total > counts[some, None], weight, np.uint64(0)).sum(axis=1, dtype=np.uint64)
    return out


def add_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint_bits",
                    shingle: int = SHINGLE) -> DataFrame:
    """Add the SimHash of each whole text as a long (its 64 bits, signed)."""
    def run(batch):
        drop_worker_state()
        return {out: pa.array(fingerprints_of(*text_column(batch.column(text)), shingle).view(np.int64))}

    return add_by_slice(docs, text, run, {out: T.LongType()})


def _quarter_counts(bits):
    return [F.bit_count(F.shiftrightunsigned(bits, 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(QUARTERS)]


def _tile(counts):
    code = F.lit(0)
    for c in counts:
        code = code * 17 + c
    return code.cast("int")


def neighbour_steps(radius: int) -> list[tuple[int, ...]]:
    """Count differences of tiles within ``radius``, one of each opposite pair."""
    every = itertools.product(range(-radius, radius + 1), repeat=QUARTERS)
    return [s for s in every if sum(map(abs, s)) <= radius and s > (0,) * QUARTERS]


def _forest(pairs: np.ndarray, nodes: int) -> np.ndarray:
    """Pairs that join different trees, each node's links to smaller ones first."""
    parent = list(range(nodes))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return np.array(kept, np.int64).reshape(-1, 2)


class Block:
    """Up to ``BLOCK`` fingerprints of a tile, compared with a stream of visitors."""

    def __init__(self, radius: int):
        self.radius, self.own, self.pairs = radius, np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)

    def _close(self, others: np.ndarray):
        for k in range(0, len(others), 512):
            some = others[k:k + 512]
            near = np.bitwise_count(some[:, None] ^ self.own[None, :]) <= self.radius
            yield k, near

    def _note(self, near: np.ndarray, first: np.ndarray):
        row, own = np.nonzero(near)
        pairs = np.unique(np.stack([first[row], own], 1), axis=0)
        self.pairs = np.concatenate([self.pairs, pairs[pairs[:, 0] != pairs[:, 1]]])
        if len(self.pairs) > 16 * BLOCK:
            self.pairs = _forest(self.pairs, len(self.own))

    def set_own(self, own: np.ndarray):
        self.own = own
        for k, near in self._close(own):
            near &= np.arange(len(own))[None, :] >= k + np.arange(len(near))[:, None]
            # The diagonal is set, so a row's first match at or after itself is itself.
            self._note(near, k + np.arange(len(near)))

    def visit(self, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links (visitor, first fingerprint of the block within the radius)."""
        left, right = [], []
        for k, near in self._close(others):
            hit = near.any(axis=1)
            first = near.argmax(axis=1)
            left.append(others[k:k + 512][hit])
            right.append(self.own[first[hit]])
            self._note(near[hit], first[hit])
        return np.concatenate(left), np.concatenate(right)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        kept = _forest(self.pairs, len(self.own))
        return self.own[kept[:, 0]], self.own[kept[:, 1]]


def _compare(radius: int):
    def run(batches):
        key, block, waiting = None, None, []

        def edges(a, b):
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            tile, part = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("tile", "part"))
            visitor = batch.column("visitor").to_numpy(zero_copy_only=False).astype(np.int64)
            bits = batch.column("bits").to_numpy(zero_copy_only=False).view(np.uint64)
            change = np.flatnonzero((np.diff(tile) != 0) | (np.diff(part) != 0) | (np.diff(visitor) != 0)) + 1
            cuts = np.concatenate([[0], change, [len(tile)]]) if len(tile) else np.zeros(1, np.int64)
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if (tile[s], part[s]) != key:
                    if block is not None or waiting:
                        block = block or _ready(waiting, radius)
                        yield edges(*block.links())
                    key, block, waiting = (tile[s], part[s]), None, []
                if not visitor[s]:
                    waiting.append(bits[s:e].copy())
                    continue
                if block is None:
                    block = _ready(waiting, radius)
                yield edges(*block.visit(bits[s:e]))
        if block is not None or waiting:
            yield edges(*(block or _ready(waiting, radius)).links())
        key = block = waiting = None
        give_back()

    return run


def _ready(waiting: list[np.ndarray], radius: int) -> Block:
    block = Block(radius)
    block.set_own(np.concatenate(waiting) if waiting else np.zeros(0, np.uint64))
    return block


def fingerprint_links(prints: DataFrame, bits: str, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly those which a
    chain of links within ``radius`` connects."""
    own = prints.select(F.col(bits).alias("bits")).distinct()
    counts = _quarter_counts(F.col("bits"))
    home = own.select("bits", *[c.alias(f"c{i}") for i, c in enumerate(counts)])
    here = [F.col(f"c{i}") for i in range(QUARTERS)]
    tiles = home.groupBy(_tile(here).alias("tile")).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("parts"))
    steps = [F.struct(F.lit(1).alias("visitor"), _tile([c + d for c, d in zip(here, s)]).alias("tile"))
             for s in neighbour_steps(radius)]
    inside = [F.forall(F.array(*[c + d for c, d in zip(here, s)]), lambda v: v.between(0, 16))
              for s in neighbour_steps(radius)]
    visits = F.filter(F.array(*[F.when(ok, s) for ok, s in zip(inside, steps)]), lambda v: v.isNotNull())
    stay = F.struct(F.lit(0).alias("visitor"), _tile(here).alias("tile"))
    rows = home.select("bits", F.explode(F.concat(F.array(stay), visits)).alias("v")).select("bits", "v.*")
    # A tile's own row is at home in one block and visits the blocks before it.
    block = F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int")
    at = F.when(F.col("visitor") == 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(
        F.sequence(F.lit(0), block))
    # Spark takes visitors for as few as fingerprints and would broadcast them. Tiles are
    # 17**4 at most.
    placed = rows.join(F.broadcast(tiles), "tile").select(
        "bits", "tile", F.col("visitor").alias("guest"), block.alias("block"), F.explode(at).alias("part"))
    placed = placed.select("bits", "tile", "part", F.when(
        (F.col("guest") == 0) & (F.col("block") == F.col("part")), 0).otherwise(1).alias("visitor"))
    dealt = placed.repartition(F.col("tile"), F.col("part")).sortWithinPartitions("tile", "part", "visitor", "bits")
    return dealt.mapInArrow(_compare(radius), "a long, b long")


def near_duplicate_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE,
) -> DataFrame:
    """(key, bits, component): every document with its SimHash and the smallest key
    that a chain of links within ``radius`` reaches, itself included.

    A null or empty text, or one of white space, has fingerprint 0 and is linked like
    any other. Repeated rows stay repeated. A null key is reached but never smallest,
    unless the component has no other; then its component is null.
    """
    rows = add_fingerprint(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", "bits", shingle)
    rows = settle(rows.select("key", "bits"), "fingerprints")
    prints = settle(rows.groupBy("bits").agg(F.min("key").alias("least")), "prints")
    roots = settle(component_roots(fingerprint_links(prints, "bits", radius)), "roots")
    named = prints.join(join_side(roots), F.col("bits") == F.col("node"), "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    classes = join_side(settle(named.join(smallest, "root").select("bits", "component"), "classes"))
    return rows.join(classes, "bits").select("key", "bits", "component")


def near_duplicate_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return near_duplicate_classes(docs, key, text).select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"))


def keep_smallest_keys(docs: DataFrame, classes: DataFrame, mark: str, add, key: str) -> DataFrame:
    """The documents with the smallest key of their class, given (key, mark, component);
    ``add(docs, name)`` adds a document's mark under that name."""
    p = free_prefix(docs)
    name, bits, at = f"{p}key", f"{p}bits", f"{p}at"
    kept = classes.where(F.col("key").eqNullSafe(F.col("component"))).select(
        F.col("key").alias(name), F.col(mark).alias(bits)).distinct()
    kept = kept.withColumn(at, F.xxhash64(name, bits))
    marked = add(docs, f"{p}print")
    marked = marked.withColumn(f"{p}hash", F.xxhash64(key, f"{p}print"))
    out = marked.join(kept, (F.col(f"{p}hash") == F.col(at)) & F.col(key).eqNullSafe(F.col(name)) & (
        F.col(f"{p}print") == F.col(bits)), "left_semi")
    # Already dealt by that hash, so this shuffles nothing.
    return out.dropDuplicates([f"{p}hash", key, f"{p}print"]).select(*docs.columns)


def keep_one_per_class(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE,
) -> DataFrame:
    """The documents whose key is the smallest of their class, with their own columns.

    Of repeated rows with that key one stays; documents with a null key stay only if
    their class has no other, one of them.
    """
    classes = near_duplicate_classes(docs, key, text, radius, shingle)
    return keep_smallest_keys(docs, classes, "bits", lambda d, out: add_fingerprint(d, text, out, shingle), key)
