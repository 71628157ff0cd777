"""Language ID by nearest centroid.

A text is a TF-IDF vector of hashed byte bigrams and trigrams inside its words, of
length 1. Each language has several centroids, found by spherical k-means in one
task per language over a bounded sample (``sample_per_language`` documents, chosen
by hash). The inverse document frequencies come from all training documents. A text
gets the language of the centroid with the largest cosine; it is rejected if that
cosine is below ``slack`` times the smallest that language's own sample has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import settle
from .common import add_by_slice, drop_worker_state, slices, text_column

BUCKETS = 1 << 13
CENTROIDS = 4
SAMPLE_PER_LANGUAGE = 1000
#: Rows that a task turns into dense vectors at once.
VECTOR_ROWS = 256
SLACK = 0.2
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII other than letters reads as a space.
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:0x80] = 0x20
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)


def gram_counts(texts: pa.Array) -> np.ndarray:
    """Texts by hashed bigrams and trigrams whose first (or middle) byte is in a word."""
    data, at = text_column(pc.utf8_lower(texts))
    data = _LETTERS[data].astype(np.uint32)
    before, after = np.full_like(data, 0x20), np.full_like(data, 0x20)
    before[1:], after[:-1] = data[:-1], data[1:]
    edges = at[:-1][at[:-1] < at[1:]]
    before[edges] = 0x20
    after[edges[1:] - 1] = 0x20
    used = np.flatnonzero(data != 0x20)
    row = np.searchsorted(at, used, "right") - 1
    here, after = data[used], after[used]
    pair = (here << np.uint32(8)) | after
    grams = [pair * np.uint32(0x9E3779B1), ((before[used] << np.uint32(16)) | pair) * np.uint32(0x85EBCA77)]
    at_row = row * BUCKETS
    cells = np.concatenate([at_row + (g >> np.uint32(19)) for g in grams])
    return np.bincount(cells, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(gram_counts(texts).astype(np.float32)) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.maximum(norm, 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows far from each other."""
    picks, best = [0], x @ x[0]
    while len(picks) < min(k, len(x)):
        nxt = int(np.argmin(best))
        if best[nxt] > 1 - 1e-6:
            break
        picks.append(nxt)
        best = np.maximum(best, x @ x[nxt])
    centres = x[picks]
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([x[of == i].sum(axis=0) if (of == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass
class Model:
    """Centroids (rows), the language of each, the least cosine each language accepts."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is rejected, for each text."""
        some = np.array([bool(t and _LETTER.search(t)) for t in texts.to_pylist()], bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), ~some
        cosine = vectors(texts, self.idf) @ self.centroids.T
        at = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(len(at)), at].astype(float), 0, 1)
        names = [self.languages[i] if ok else UNKNOWN for i, ok in zip(at.tolist(), some.tolist())]
        return names, np.where(some, score, 0.0), ~some | (score < self.least[at])


def document_frequency(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents that hold each hashed gram, and their number, over all rows."""
    def count(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in slices(batch, text, rows=VECTOR_ROWS):
                total += (gram_counts(part.column(text)) > 0).sum(axis=0)
                n += part.num_rows
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BUCKETS + 1), pa.int32()), pa.array([*total, n], pa.int64())], names=["gram", "n"])

    rows = docs.select(text).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        out[r["gram"]] = r["n"]
    return out[:-1], int(out[-1])


def fit(
    docs: DataFrame, text: str = "text", label: str = "lang", buckets_per_language: int = CENTROIDS,
    sample_per_language: int = SAMPLE_PER_LANGUAGE, slack: float = SLACK,
) -> Model:
    """Learn from the rows with a label and a text with content.

    The sample has ``sample_per_language`` documents a language, give or take its
    square root; the languages' centroids are what goes to the driver.
    """
    train = docs.select(F.col(text).alias("text"), F.col(label).alias("label")).where(
        F.col("label").isNotNull() & (F.length(F.trim("text")) > 0))
    sizes = settle(train.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "languages")
    seen, n = document_frequency(train, "text")
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003
    sample = train.join(sizes, "label").where(place < F.lit(float(sample_per_language)) / F.col("n"))

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf["text"].sort_values(kind="stable").to_numpy()
        x = np.concatenate([vectors(pa.array(texts[i:i + 200], pa.string()), idf) for i in range(0, len(texts), 200)])
        x = x[(x > 0).any(axis=1)]
        if not len(x):
            return pd.DataFrame({"label": [], "part": [], "least": [], "centre": []})
        found = cluster(x, buckets_per_language)
        return pd.DataFrame({
            "label": pdf["label"].iloc[0], "part": range(len(found)), "least": float((x @ found.T).max(axis=1).min()),
            "centre": [c.tolist() for c in found]})

    kinds = dict(train.dtypes)["label"]
    rows = sample.select("label", "text").groupBy("label").applyInPandas(
        centres, f"label {kinds}, part int, least double, centre array<float>").collect()
    rows.sort(key=lambda r: (str(r["label"]), r["part"]))
    return Model(
        idf, np.array([r["centre"] for r in rows], np.float32).reshape(-1, BUCKETS),
        [str(r["label"]) for r in rows], slack * np.array([r["least"] for r in rows]))


def add_language(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """Add ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    A null text and one without a letter are ``und`` with score 0, and rejected. With
    no centroid (nothing to learn from) every text is ``und``, and those with a letter
    are not rejected. Between equal cosines the first language by name wins.
    """
    def run(batch):
        drop_worker_state()
        names, score, rejected = model.predict(batch.column(text))
        return {f"{prefix}lang_pred": pa.array(names, pa.string()), f"{prefix}score": pa.array(score, pa.float64()),
                f"{prefix}rejected": pa.array(rejected, pa.bool_())}

    return add_by_slice(docs, text, run, {
        f"{prefix}lang_pred": T.StringType(), f"{prefix}score": T.DoubleType(), f"{prefix}rejected": T.BooleanType()},
        rows=VECTOR_ROWS)


def held_out(key: Column) -> Column:
    """A fifth of the keys, by the CRC-32 of their text; a null key is one of them."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def held_out_report(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Predictions for all documents by a model of those not held out."""
    model = fit(docs.where(~held_out(F.col(key))), text, label)
    own = docs.select(F.col(key), F.col(text), held_out(F.col(key)).alias("held_out"))
    return add_language(own, model, text).select(key, "held_out", "lang_pred", "score", "rejected")
