"""Sharding by sampled splitters: shards of near equal size.

Rows are ordered by (text checksum, hash of key and text): equal texts stand
together. A size-weighted sample of these places gives quantile splitters for many
ranges a shard. A splitter that falls inside a group of equal texts moves to the
group's start, unless the group is overfull (over a quarter of a shard, or over
``ROWS_PER_RANGE`` rows): such a group is subdivided, all others stay whole. The ranges' exact sizes, few numbers,
decide which shard each goes to, largest first to the lightest shard. A row's slot is
the rows of its shard's earlier ranges plus its place in its range.

Everything is DataFrame functions. Only a digest of 40 bytes a row is shuffled,
never the texts.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import settle
from .common import empty_if_null
from .ordered import bucket_of

RANGES_PER_SHARD = 64
ROWS_PER_RANGE = 1_000_000
SAMPLE_PER_RANGE = 32
ROW_BYTES = 8
#: Places are 32 bits of checksum, then 20 of hash, so that doubles hold them exactly.
HASH_BITS = 20


def _choose(sizes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(range, shard, first slot): largest ranges first, each to the lightest shard;
    ties by range and shard number. ``sizes``: (range, bytes, rows)."""
    heap = [(0, s) for s in range(shards)]
    where = {}
    for r, size, _ in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        where[r] = s
        heapq.heappush(heap, (load + size, s))
    filled, out = [0] * shards, []
    for r, _, rows in sorted(sizes):
        out.append((r, where[r], filled[where[r]]))
        filled[where[r]] += rows
    return out


def _table(values: dict[int, int], at: Column, n: int) -> Column:
    """A literal array as a lookup table."""
    listed = [values.get(i, 0) for i in range(n)]
    return F.get(F.from_json(F.lit(json.dumps(listed)), "array<bigint>"), at)


def splitters_of(rows: DataFrame, shards: int, ranges: int, total: int) -> list[int]:
    """Quantile places of a size-weighted sample, outside all groups but overfull ones."""
    step = max(total / (ranges * SAMPLE_PER_RANGE), 1.0)
    chance = F.pmod(F.xxhash64("place", "size", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    draws = F.floor(F.col("size") / F.lit(step) + chance).cast("long")
    wanted = [i / ranges for i in range(1, ranges)]
    if not wanted:
        return []
    got = rows.select("place", draws.alias("draws")).where("draws > 0").agg(
        F.percentile("place", wanted, F.col("draws")).alias("q")).first()["q"] or []
    places = sorted({math.ceil(x) for x in got})
    groups = rows.groupBy("crc").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    large = groups.where((F.col("bytes") > total / shards / 4) | (F.col("n") > ROWS_PER_RANGE)).select("crc").collect()
    keep = {r["crc"] for r in large}
    return sorted({p if (p >> HASH_BITS) in keep else p >> HASH_BITS << HASH_BITS for p in places})


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row, shards 0 to ``shards`` - 1.

    Size is the text's UTF-8 bytes plus 8; a null text has none. Repeated rows are all
    kept, at neighbouring slots of one shard unless an overfull range ends between
    them; a null key is like any other. An empty table gives no row. The order inside a
    range is that of (place, key, size).
    """
    body = empty_if_null(F.col(text)).cast("binary")
    crc = F.crc32(body)
    mix = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << HASH_BITS))
    rows = settle(docs.select(
        F.col(key).alias("key"), (F.octet_length(body) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        crc.alias("crc"), (F.shiftleft(crc, HASH_BITS) + mix).alias("place")), "digest")
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    ranges = max(shards * RANGES_PER_SHARD, -(-n // ROWS_PER_RANGE))
    found = splitters_of(rows, shards, ranges, total or 0)
    of = bucket_of(F.struct(F.col("place").alias("k0")), [{"k0": s} for s in found], "struct<k0:bigint>")
    rows = rows.withColumn("range", of)
    sizes = [tuple(r) for r in rows.groupBy("range").agg(F.sum("size"), F.count(F.lit(1))).collect()]
    plan = _choose(sizes, shards)
    inside = Window.partitionBy("range").orderBy("place", F.col("key").asc_nulls_first(), "size")
    numbered = rows.withColumn("nth", F.row_number().over(inside) - 1)
    m = len(found) + 1
    return numbered.select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"),
        _table({r: s for r, s, _ in plan}, F.col("range"), m).cast("int").alias("shard"),
        (_table({r: f for r, _, f in plan}, F.col("range"), m) + F.col("nth")).alias("slot"))


def shard_report(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    return assign_shards(docs, shards, key, text).select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, shards: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the documents as ``folder``/shard=N, one directory a shard.

    Rows are matched with their shards by key and checksum; repeated rows that lie on
    both sides of a boundary all go to the first of their shards.
    """
    placed = assign_shards(docs, shards, key, text).groupBy(key, "text_crc32", "size").agg(F.min("shard").alias("shard"))
    placed = placed.withColumnsRenamed({key: "_key", "text_crc32": "_crc", "size": "_size", "shard": "_shard"})
    body = empty_if_null(F.col(text)).cast("binary")
    own = docs.withColumns({"_body_crc": F.crc32(body), "_body_size": (F.octet_length(body) + F.lit(ROW_BYTES)).cast("long")})
    joined = own.join(placed, own[key].eqNullSafe(F.col("_key")) & (F.col("_body_crc") == F.col("_crc")) & (
        F.col("_body_size") == F.col("_size")))
    joined.select(*docs.columns, F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(folder)
