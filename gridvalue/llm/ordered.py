"""Rows in a total order over many tasks, each task with the rows next to its own.

A bounded sample of keys gives splitters; a row's bucket is the number of splitters
not above its key, found by binary search in a literal array. Rows with one key
share a bucket. There are several buckets a task, so hash partitioning deals them
out evenly, and a task for every ``ROWS_PER_PARTITION`` rows. The sample, and so what
goes to the driver, is bounded by ``MOST_BUCKETS``; beyond that buckets grow. The rows with the last (first) key of a bucket also go to the next
(previous) bucket, so a task sees across its edges without another pass.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix

ROWS_PER_PARTITION = 20_000
BUCKETS_PER_PARTITION = 8
MOST_BUCKETS = 1 << 16
SAMPLE_PER_BUCKET = 20


def _literal(rows: list, kind: str) -> Column:
    """A constant array as one literal; expressions of many small ones plan slowly."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")


def bucket_of(key: Column, splitters: list[list], kind: str) -> Column:
    """Number of splitters not above the key."""
    if not splitters:
        return F.lit(0)
    known = _literal(splitters, kind)

    def step(s, _):
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        return F.when(s["lo"] >= s["hi"], s).when(
            F.get(known, middle) <= key, F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))
        ).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))

    rounds = math.ceil(math.log2(len(splitters) + 1)) + 1
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: s["lo"])


def in_order(
    df: DataFrame, keys: list[str], before: bool = False, after: bool = False, ring: bool = False,
    ties: list[str] | None = None,
) -> tuple[DataFrame, str, str, int]:
    """The frame dealt to tasks in buckets of key order (nulls first) and sorted within.

    Returns it with two new columns, their names, and the number of buckets:
    the bucket, and the side: 0 for a bucket's own rows, -1 for the rows with the
    last key before the bucket (if ``before``; on a ``ring`` the very last key comes
    before the first), 1 for those with the first key after it (if ``after``). Rows
    are sorted by bucket, side, keys, ``ties``.
    """
    p = free_prefix(df)
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    kind = f"struct<{','.join(f'k{i}:{kinds[k]}' for i, k in enumerate(keys))}>"
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    only = df.select(*keys)
    rows = only.count()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_PARTITION))
    buckets = min(BUCKETS_PER_PARTITION * partitions, MOST_BUCKETS)
    share = SAMPLE_PER_BUCKET * buckets / max(rows, 1)
    picked = only.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) < int(min(share, 1) * (1 << 20)) + 1)
    sample = [r["k"] for r in picked.select(key.alias("k")).orderBy("k").collect()]
    step = max(len(sample) // buckets, 1)
    splitters = _distinct(sample[step::step])
    names = [f"k{i}" for i in range(len(keys))]
    bucket = bucket_of(key, [dict(zip(names, s)) for s in splitters], kind)
    placed = df.withColumn(f"{p}bucket", bucket)
    to = F.array(F.struct(F.col(f"{p}bucket").alias("bucket"), F.lit(0).alias("side")))
    if before or after:
        ends = only.select(bucket.alias("b"), key.alias("k")).groupBy("b").agg(
            F.min("k").alias("first"), F.max("k").alias("last")).orderBy("b").collect()
        to = F.concat(to, *_carried(ends, before, after, ring, key, F.col(f"{p}bucket"), names, kind, len(splitters) + 1))
    sent = placed.withColumn(f"{p}to", F.explode(to))
    sent = sent.withColumn(f"{p}side", F.col(f"{p}to.side")).withColumn(f"{p}bucket", F.col(f"{p}to.bucket"))
    dealt = sent.drop(f"{p}to").repartition(partitions, F.col(f"{p}bucket")).sortWithinPartitions(
        f"{p}bucket", f"{p}side", *[F.col(k).asc_nulls_first() for k in [*keys, *(ties or [])]])
    return dealt, f"{p}bucket", f"{p}side", len(splitters) + 1


def _distinct(rows: list) -> list[tuple]:
    """Neighbours that differ, of rows already in order."""
    out: list[tuple] = []
    for r in rows:
        if not out or out[-1] != tuple(r):
            out.append(tuple(r))
    return out


def _carried(ends, before, after, ring, key, bucket, names, kind, n) -> list[Column]:
    """For a row with an edge key of its bucket, the neighbour buckets that need it."""
    out = []
    for side, on in ((-1, before), (1, after)):
        edges: list = [None] * n
        target: list = [None] * n
        for i, e in enumerate(ends):
            j = i - side
            if on and (0 <= j < len(ends) or (ring and side == -1)):
                edges[e["b"]] = dict(zip(names, e["last" if side == -1 else "first"]))
                target[e["b"]] = ends[j % len(ends)]["b"]
        if any(t is not None for t in target):
            at_edge = F.get(_literal(edges, kind), bucket).eqNullSafe(key) & F.get(_literal(target, "int"), bucket).isNotNull()
            out.append(F.when(at_edge, F.array(F.struct(
                F.get(_literal(target, "int"), bucket).alias("bucket"), F.lit(side).alias("side")))).otherwise(
                F.array().cast("array<struct<bucket:int,side:int>>")))
    return out
