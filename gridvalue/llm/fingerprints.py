"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, modulo a prime, the polynomial hash of each of
its beginnings; the hash of any span is a difference of two entries. Two spans are
equal when their hashes are, at any offsets, and the longest common extension of
two places is found by binary search over its length.

A fingerprint keeps the whole text's hash and length, and the hashes of the
beginnings and the ends whose lengths lie on a geometric grid that all texts share.
The grid hashes of two texts agree up to their longest common beginning (end) and
differ beyond, so binary search finds it from the fingerprints alone.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_by_slice, slices
from .ordered import in_order

#: Primes and bases: the first pair alone makes the samples.
PRIMES = ((2**31 - 1, 1_103_515_245), (2**31 - 19, 1_566_083_941))
#: A grid length is followed by one larger by an eighth.
GRID_STEP = 8


def grid(n: int) -> np.ndarray:
    """Grid lengths up to ``n``."""
    out, g = [], 1
    while g <= n:
        out.append(g)
        g += max(1, g // GRID_STEP)
    return np.array(out, np.int64)


class Prefixes:
    """Prefix arrays of many texts, back to back, modulo one prime."""

    _tables: dict = {}

    def __init__(self, points: np.ndarray, at: np.ndarray, prime: int, base: int):
        self.at, self.prime = at, np.uint64(prime)
        self.up, self.down = self._powers(prime, base, int(np.diff(at).max(initial=0)) + 1)
        place = np.arange(len(points)) - np.repeat(at[:-1], np.diff(at))
        terms = (points.astype(np.uint64) + np.uint64(1)) * self.up[place] % self.prime
        # Sums of residues, not residues: under 2**64 for up to 2**33 code points.
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])

    @classmethod
    def _powers(cls, prime: int, base: int, n: int):
        have = cls._tables.get(prime)
        if have is None or len(have[0]) < n:
            have = []
            for b in (base, pow(base, -1, prime)):
                out, size = np.ones(n, np.uint64), 1
                while size < n:
                    take = min(size, n - size)
                    out[size:size + take] = out[:take] * np.uint64(pow(b, size, prime)) % np.uint64(prime)
                    size += take
                have.append(out)
            cls._tables[prime] = have
        return have

    def spans(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of code points start..end of each text, as if it stood at the text's start."""
        raw = (self.sums[self.at[text] + end] - self.sums[self.at[text] + start]) % self.prime
        return raw * self.down[start] % self.prime


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def fingerprint_texts(texts: list[str]) -> list[str]:
    """``length.whole.beginnings.ends``; four base64 digits for a grid length."""
    points, at = code_points(texts)
    n = np.diff(at)
    every = grid(int(n.max(initial=0)))
    used = np.searchsorted(every, n, "right")
    text = np.repeat(np.arange(len(n)), used)
    first = np.concatenate([[0], np.cumsum(used)])
    length = every[np.arange(len(text)) - first[text]]
    whole, samples = [], ()
    for i, (prime, base) in enumerate(PRIMES):
        h = Prefixes(points, at, prime, base)
        whole.append(h.spans(np.arange(len(n)), np.zeros_like(n), n))
        if i == 0:
            zero = np.zeros_like(length)
            samples = h.spans(text, zero, length), h.spans(text, n[text] - length, n[text])
    digits = [base64.b64encode(s.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()).decode() for s in samples]
    return [f"{size:x}.{a:08x}{b:08x}.{digits[0][4 * s:4 * e]}.{digits[1][4 * s:4 * e]}" for size, a, b, s, e in zip(
        n.tolist(), whole[0].tolist(), whole[1].tolist(), first[:-1].tolist(), first[1:].tolist())]


_GRID = grid(1 << 40).tolist()


def _common(a: str, b: str) -> int:
    """Longest grid length at which the samples agree; they agree below it, too."""
    low, high = 0, min(len(a), len(b)) // 4
    while low < high:
        middle = (low + high + 1) // 2
        if a[4 * middle - 4:4 * middle] == b[4 * middle - 4:4 * middle]:
            low = middle
        else:
            high = middle - 1
    return _GRID[low - 1] if low else 0


def likeness(a: str, b: str) -> float:
    """Common beginning and end of two fingerprints' texts against the longer text: 1
    for equal texts, 0 if neither end agrees."""
    if a == b:
        return 1.0
    n, _, head, tail = a.split(".")
    m, _, other_head, other_tail = b.split(".")
    n, m = int(n, 16), int(m, 16)
    shared = min(_common(head, other_head) + _common(tail, other_tail), n, m)
    return shared / max(n, m)


def add_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of each whole text; a null text counts as empty."""
    def run(batch):
        return {out: pa.array(fingerprint_texts([t or "" for t in batch.column(text).to_pylist()]), pa.string())}

    return add_by_slice(docs, text, run, {out: T.StringType()})


def add_common_extension(
    pairs: DataFrame, left: str, left_at: str, right: str, right_at: str, out: str = "common",
) -> DataFrame:
    """Add the number of code points that two texts share from given places on.

    Places count from 0; those outside a text, and nulls, give 0. Equality rests on
    62 bits of hash for each of the lengths tried.
    """
    def run(batch):
        sides = []
        for name, place in ((left, left_at), (right, right_at)):
            points, at = code_points([t or "" for t in batch.column(name).to_pylist()])
            starts = np.array([-1 if v is None else v for v in batch.column(place).to_pylist()], np.int64)
            sides.append((np.diff(at), starts, [Prefixes(points, at, *p) for p in PRIMES]))
        (n, i, hn), (m, j, hm) = sides
        valid = (i >= 0) & (i < n) & (j >= 0) & (j < m)
        low = np.zeros(batch.num_rows, np.int64)
        high = np.where(valid, np.minimum(n - i, m - j), 0)
        rows, i, j = np.arange(batch.num_rows), np.where(valid, i, 0), np.where(valid, j, 0)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = np.ones(batch.num_rows, bool)
            for a, b in zip(hn, hm):
                same &= a.spans(rows, i, i + middle) == b.spans(rows, j, j + middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return {out: pa.array(low)}

    return add_by_slice(pairs, left, run, {out: T.LongType()})


def edited(text: str, other: str) -> str:
    """The last third of ``text`` replaced by as much of the start of ``other``."""
    third = len(text) // 3
    return text[:len(text) - third] + other[:third]


def edit_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint and that of its text edited with the next document,
    in descending order of the key, nulls last; after the last comes the first.

    Documents with equal keys follow each other by descending text. A null text is
    empty; two empty texts are equal. A single document is its own next one.
    """
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt, bucket, side, _ = in_order(own, ["key"], before=True, ring=True, ties=["text"])
    fields = T.StructType([
        T.StructField(key, dealt.schema["key"].dataType), T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType())])

    def run(batches):
        last_bucket, last_text, last_print = None, "", ""
        for batch in batches:
            for part in slices(batch, "text"):
                texts, sides = part.column("text").to_pylist(), part.column(side).to_pylist()
                of = part.column(bucket).to_pylist()
                prints = fingerprint_texts(texts)
                nexts, next_prints = [last_text, *texts[:-1]], [last_print, *prints[:-1]]
                if any(b != a and s == 0 for a, b, s in zip([last_bucket, *of[:-1]], of, sides)):
                    raise RuntimeError("a bucket lacks the row before its first")
                last_bucket, last_text, last_print = of[-1], texts[-1], prints[-1]
                rows = [i for i, s in enumerate(sides) if s == 0]
                if not rows:
                    continue
                made = [edited(texts[i], nexts[i]) for i in rows]
                made_prints = fingerprint_texts(made)
                yield pa.RecordBatch.from_arrays([
                    part.column("key").take(pa.array(rows)), pa.array([len(texts[i]) for i in rows], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in made]),
                    pa.array([prints[i] for i in rows]), pa.array(made_prints),
                    pa.array([likeness(prints[i], m) for i, m in zip(rows, made_prints)]),
                    pa.array([likeness(prints[i], next_prints[i]) for i in rows]),
                ], names=fields.names)

    return dealt.select("key", "text", bucket, side).mapInArrow(run, fields)
