"""Token ids as Parquet files in document order, for selective reads.

Documents are dealt to tasks in ranges of their key and sorted, encoded there, and
written as rows (key, range, place within the range, count, ids). Ids are a list
column with dictionary encoding (16 bits an id or fewer); the other columns are
delta encoded. Row groups and pages have set sizes, and the column and page indexes
let a reader fetch the lengths without the ids, or the ids of a few documents. A
manifest gives each range's first id, so a document's place in the whole stream is a
sum of two stored numbers.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import sys
import types
import uuid
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import shared_folder
from .common import WORKER_STATE, slices
from .ordered import in_order

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1000
END_ID = 0
#: Pieces of text whose ids a Python worker keeps, in two generations of half of them.
CACHED_PIECES = 500_000

_INNER_SPACE = re.compile(r" (?=\S)")
#: Some letters: all of Basic Latin and Latin-1. Other letters only make longer parts.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_WORD = re.compile(f"[{_LETTER}]+")
#: Places where the byte-level pre-tokenizer always splits, whatever stands around them: a
#: run of letters ends before any other ASCII character, a run of marks (an apostrophe may
#: begin a contraction) or a line end after no other space before a letter.
_SPLITS = re.compile(
    f"(?<=[{_LETTER}])(?=[\0-@\\[-`{{-\x7f])|(?<=[!-&(-/:-@\\[-`{{-~])(?=[{_LETTER}])|(?<=\\S\n)(?=[{_LETTER}])")


def worker_state(name: str, make: Callable[[], object]):
    """A value that a Python worker keeps from task to task."""
    held = sys.modules.setdefault(WORKER_STATE, types.ModuleType(WORKER_STATE))
    if name not in held.__dict__:
        held.__dict__[name] = make()
    return held.__dict__[name]


class _Spaces(Exception):
    """A space here does not start a piece."""


class _Kept(dict):
    """Values of ``make`` for all keys asked for, and what is left of the generation before."""

    def __init__(self, make: Callable[[str], bytes], old: dict[str, bytes]):
        self.make, self.old = make, old

    def __missing__(self, key: str) -> bytes:
        self[key] = value = self.old.get(key) or self.make(key)
        return value


class Encoder:
    """The tokenizers library behind a cache of pieces and of their parts.

    A piece is what a space followed by another character starts; the byte-level
    pre-tokenizer always splits there, so a text's ids are its pieces' ids in turn.
    A piece's parts are what ``_SPLITS`` leaves of it. A part of letters alone is one
    word of the pre-tokenizer and goes to the library's model, any other part to the
    whole library. Texts with an added token's string are encoded whole, as are all
    texts if the tokenizer is not a byte-level BPE without a normalizer.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        # One thread a task: Spark runs as many tasks as there are cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        own = json.loads(tokenizer_json)
        before = own["pre_tokenizer"] or {}
        self.by_piece = (
            own["normalizer"] is None and own["post_processor"] is None and own["truncation"] is None
            and own["padding"] is None and own["model"]["type"] == "BPE" and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space", True))
        # The byte-level alphabet: printable bytes stand for themselves, others follow from 256.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = itertools.count(256)
        self.alphabet = [b if b in shown else next(others) for b in range(256)]
        self.space = chr(self.alphabet[32])
        #: Ids by piece without its leading space, and by part that follows another.
        self.pieces, self.tails = _Kept(self._piece, {}), _Kept(self._part, {})

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _part(self, part: str, lead: str = "") -> bytes:
        """Ids of ``part`` after ``lead``, a space or nothing."""
        if part.isascii() and part.isalpha():
            word = self.space + part if lead else part
        elif _WORD.fullmatch(part):
            word = (lead + part).encode().decode("latin-1").translate(self.alphabet)
        else:
            return self._whole(lead + part)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a space and ``piece``."""
        if piece.isalpha():
            return self._part(piece, " ")
        if not piece or piece[0].isspace():
            raise _Spaces
        first, *rest = _SPLITS.split(piece)
        if not rest:
            return self._part(piece, " ")
        return self.pieces[first] + b"".join(map(self.tails.__getitem__, rest))

    def _joined(self, head: str, *pieces: str) -> bytes:
        """Ids of ``head``, which no space leads, and of pieces."""
        heads = map(self.tails.__getitem__, _SPLITS.split(head)) if head else ()
        return b"".join(heads) + b"".join(map(self.pieces.__getitem__, pieces))

    def _text(self, text: str) -> bytes:
        if not self.by_piece or self.added and self.added.search(text):
            return self._whole(text)
        for kept in ("pieces", "tails"):
            now = getattr(self, kept)
            if len(now) > CACHED_PIECES // 2:
                setattr(self, kept, _Kept(now.make, dict(now)))
        try:
            return self._joined(*text.split(" "))
        except _Spaces:
            return self._joined(*_INNER_SPACE.split(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [self._text(text) for text in texts]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_json: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
) -> None:
    """Write ``folder``/tokens (key, range, place, n_tokens, ids) and ``folder``/manifest
    (range, start).

    A null text is empty; every document ends with ``end_id``. Ranges ascend by key,
    nulls first, and so do the rows of a range; equal keys stand in order of text.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt, bucket, _, _ = in_order(own, ["key"], ties=["text"])
    shared = spark.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], "<u4").tobytes()
    name = f"encoder-{zlib.crc32(tokenizer_json.encode())}"

    def encode(batches):
        encoder = worker_state(name, lambda: Encoder(shared.value))
        now, place = None, 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [i + end for i in encoder.encode(part.column("text").to_pylist())]
                sizes = np.array([len(i) // 4 for i in ids], np.int64)
                of = part.column(bucket).to_numpy(zero_copy_only=False)
                places = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                first = np.flatnonzero(np.concatenate([[of[0] != now], of[1:] != of[:-1]]))
                # Places count from the range's first row, which an earlier slice may hold.
                run = np.searchsorted(first, np.arange(len(of)), "right")
                places -= np.concatenate([[-place], places[first]])[run]
                now, place = of[-1], int(places[-1] + sizes[-1])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(of, pa.int32()), pa.array(places), pa.array(sizes),
                     pa.ListArray.from_arrays(offsets, values)], names=["key", "range", "place", "n_tokens", "ids"])

    kind = dict(own.dtypes)["key"]
    rows = dealt.select("key", "text", bucket).mapInArrow(
        encode, f"key {kind}, range int, place long, n_tokens long, ids array<int>")
    (rows.withColumnRenamed("key", key).write.option("parquet.writer.version", "v2")
     .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
     .option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.enable.dictionary", "true")
     .parquet(f"{folder}/tokens"))
    # A row a range: bounded by the number of ranges, so one window over all may sum them.
    sizes = spark.read.parquet(f"{folder}/tokens").groupBy("range").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).write.parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """(key, start, n_tokens[, ids]); without ``ids`` only the small columns are read."""
    rows = spark.read.parquet(f"{folder}/tokens")
    manifest = spark.read.parquet(f"{folder}/manifest").withColumnRenamed("start", "range_start")
    out = rows.join(manifest, "range").withColumn("start", F.col("range_start") + F.col("place"))
    return out.select(key, "start", "n_tokens", *(["ids"] if ids else []))


def with_checksum(tokens: DataFrame, out: str = "ids_crc32") -> DataFrame:
    """Replace ``ids`` by the CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    fields = [f for f in tokens.schema.fields if f.name != "ids"]

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy()
            raw = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).view(np.uint8)
            sums = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields), pa.array(sums, pa.int64())],
                names=[*(f.name for f in fields), out])

    return tokens.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.LongType())]))


def token_report(docs: DataFrame, tokenizer_json: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents' ids to the shared folder and report on them from the files."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/token_files-{uuid.uuid4().hex}"
    write_token_files(docs, folder, tokenizer_json, key, text)
    return with_checksum(read_tokens(spark, folder, key))
