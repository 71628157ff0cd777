"""Replicate weights: how often each replicate draws a unit, as one vector a unit.

Draws need no data but the size of a team: slot i of replicate s takes the unit at a
hashed position. Tasks therefore draw for blocks of slots and all replicates at once, and
what is shuffled are packed counts by range of units, under a byte a draw. Sums over units
are then products of totals and weight vectors, so units are read once however many
replicates there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import settle, union_all

UNIT = "_unit"    # unique over all teams
PLACE = "_place"  # 1..n within the team
SIZE = "_size"    # n
START = "_start"  # units of the teams before
WEIGHTS = "_weights"
FIRST_SIM = "_first_sim"

#: Draws of a block of slots, counts of a range of units, and replicates of one vector.
CELL_DRAWS = 1 << 18
RANGE_COUNTS = 1 << 21
VECTOR_SIMS = 1024
CELLS_PER_TASK = 16
ROWS_PER_OUTPUT = 1 << 13
#: Products (row, replicate, total) that are summed at once, and rows of a split up to
#: which splits are summed together.
PRODUCTS = 1 << 20
FEW_ROWS = 16


def sim_blocks(n_sims: int, first_sim: int = 1) -> list[tuple[int, int]]:
    """(first replicate, replicates) of each vector."""
    return [(first_sim + i, min(VECTOR_SIMS, n_sims - i)) for i in range(0, n_sims, VECTOR_SIMS)]


def replicate_weights(
    units: DataFrame, keys: Sequence[str], n_sims: int, seed: int = 0, first_sim: int = 1
) -> DataFrame:
    """(unit, first replicate, weights) of numbered units; ``weights[i]`` is how often
    replicate ``first + i`` draws the unit. Units that none of them draws have no row.

    The position that slot ``place`` of a team takes is in 60 bits of the MD5 hash of
    (seed, replicate, keys, place), so draws do not depend on partitioning.
    """
    teams = units.groupBy(*keys).agg(F.first(SIZE).alias(SIZE), F.first(START).alias(START))
    # The trailing empty part ends the keys with a separator; missing keys are left out.
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(""))
    teams = settle(teams.select(text.alias("team"), SIZE, START), "teams")
    return union_all([_weights(teams, seed, *block) for block in sim_blocks(n_sims, first_sim)])


def _weights(teams: DataFrame, seed: int, first: int, sims: int) -> DataFrame:
    slots, span = max(CELL_DRAWS // sims, 1), max(RANGE_COUNTS // sims, 1)
    cells = teams.agg(F.sum(F.ceil(F.col(SIZE) / F.lit(slots)))).first()[0] or 0
    # Few small rows with much work each: a fixed number of tasks, which adaptive
    # execution does not merge.
    tasks = max(teams.sparkSession.sparkContext.defaultParallelism, -(-int(cells) // CELLS_PER_TASK))
    blocks = teams.withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col(SIZE).cast("long"), F.lit(slots).cast("long"))))

    def draw(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _draws(row["team"].encode(), row[SIZE], row[START], row["slot"], slots, span, seed, first, sims)

    packed = blocks.repartition(tasks).mapInArrow(draw, "first long, n long, gaps binary")

    def count(batches):
        at, n, counts = None, 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["first"] != at:
                    if at is not None:
                        yield _unit_rows(at, n, counts, first, sims)
                    at, n, counts = row["first"], row["n"], np.zeros(row["n"] * sims, np.int64)
                cells = np.cumsum(np.frombuffer(zlib.decompress(row["gaps"]), "<u4"), dtype=np.int64)
                counts += np.bincount(cells, minlength=len(counts))
        if at is not None:
            yield _unit_rows(at, n, counts, first, sims)

    dealt = packed.repartition("first").sortWithinPartitions("first")
    return dealt.mapInArrow(count, f"{UNIT} long, {FIRST_SIM} int, {WEIGHTS} array<smallint>")


def _draws(team: bytes, size: int, start: int, slot: int, slots: int, span: int, seed: int, first: int,
           sims: int) -> pa.RecordBatch:
    """The draws of a block of slots: per range of units the gaps between the sorted cells
    (unit, replicate) drawn, packed."""
    places = [b"%d" % i for i in range(slot, min(slot + slots, size + 1))]
    cells = np.empty((sims, len(places)), np.int64)
    for s in range(sims):
        head = b"%d|%d|" % (seed, first + s) + team
        digests = b"".join([md5(head + p, usedforsecurity=False).digest() for p in places])
        cells[s] = (np.frombuffer(digests, ">u8")[::2] >> np.uint64(4)) % np.uint64(size) * np.uint64(sims) + np.uint64(s)
    cells = np.sort(cells, axis=None)
    of = cells // (span * sims)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
    firsts, sizes, gaps = [], [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        before = int(of[a]) * span
        firsts.append(start + before + 1)
        sizes.append(min(span, size - before))
        gaps.append(zlib.compress(np.diff(cells[a:b] - before * sims, prepend=0).astype("<u4").tobytes(), 1))
    return pa.RecordBatch.from_arrays(
        [pa.array(firsts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gaps, pa.binary())],
        names=["first", "n", "gaps"])


def _unit_rows(at: int, n: int, counts: np.ndarray, first: int, sims: int) -> pa.RecordBatch:
    if counts.max() > np.iinfo(np.int16).max:
        raise OverflowError(f"a unit was drawn {counts.max()} times in one replicate")
    counts = counts.reshape(n, sims)
    drawn = np.flatnonzero(counts.any(axis=1))
    ends = pa.array(np.arange(len(drawn) + 1) * sims, pa.int32())
    weights = pa.ListArray.from_arrays(ends, pa.array(counts[drawn].astype(np.int16).ravel()))
    return pa.RecordBatch.from_arrays(
        [pa.array(drawn + at), pa.array(np.full(len(drawn), first, np.int32)), weights], names=[UNIT, FIRST_SIM, WEIGHTS])


def weighted_sums(
    rows: DataFrame, splits: Sequence[str], label: Sequence[str], totals: Sequence[str], labels: str, sim: str
) -> DataFrame:
    """(splits, sim, totals, labels): totals of a split's rows times their weights in every
    replicate that draws one of them, and ``labels``, the number of distinct labels drawn.

    ``rows`` has the weight vectors of :func:`replicate_weights`; it is read twice, so
    write it. Rows are range-partitioned by (splits, label), so the rows of one split, of
    any number, are spread over tasks and each task streams through its own. Splits at a
    task's edges are summed over tasks; all others are complete there.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([
        *[T.StructField(s, kinds[s]) for s in splits], T.StructField(sim, T.IntegerType()),
        *[T.StructField(t, kinds[t]) for t in totals], T.StructField(labels, T.LongType()),
        T.StructField("_edge", T.BooleanType())])
    whole = [not isinstance(kinds[t], T.DoubleType) for t in totals]
    by: list[Column] = [F.col(c).asc_nulls_first() for c in dict.fromkeys([*splits, FIRST_SIM, *label])]
    names, split_by = schema.names, [*splits, FIRST_SIM]

    def run(batches):
        sums, out = None, _Output(names, split_by, whole)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(t).to_numpy(zero_copy_only=False).astype(float) for t in totals], axis=1)
            lists = batch.column(WEIGHTS)
            new_split = _changes(batch, split_by)
            new_label = new_split | _changes(batch, label)
            if sums is not None:
                new_split[0] = not sums.same(batch, split_by)
                new_label[0] = new_split[0] or not sums.same(batch, label)
            cuts = np.flatnonzero(new_split)
            bounds = np.array([0, *cuts[cuts > 0].tolist(), batch.num_rows])

            def single(a, b):
                w = lists.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                one = _Sums(batch.slice(a, 1), w.shape[1], x.shape[1]) if new_split[a] else sums
                one.add(x[a:b], w, np.flatnonzero(new_label[a:b]))
                return one

            if new_split[0] and sums is not None:
                out.add(sums)
            sums = single(0, int(bounds[1]))
            if len(bounds) > 2:
                out.add(sums)
                # Splits between the first and the last of a batch are complete in it.
                for i, j in _chunks(bounds[1:-1], lists, x.shape[1]):
                    if j - i == 1:
                        out.add(single(int(bounds[1 + i]), int(bounds[1 + j])))
                    else:
                        out.add_many(batch, bounds[1 + i:2 + j], lists, x, new_label)
                    if out.rows >= ROWS_PER_OUTPUT:
                        yield from out.flush()
                sums = single(int(bounds[-2]), batch.num_rows)
            sums.last = batch.slice(batch.num_rows - 1, 1)
            if out.rows >= ROWS_PER_OUTPUT:
                yield from out.flush()
        if sums is not None:
            out.add(sums, last=True)
        yield from out.flush()

    dealt = rows.select(*dict.fromkeys([*split_by, *label, *totals, WEIGHTS])).repartitionByRange(*by).sortWithinPartitions(*by)
    made = settle(dealt.mapInArrow(run, schema), "weighted_sums")
    edges = made.where("_edge").groupBy(*splits, sim).agg(*[F.sum(c).alias(c) for c in [*totals, labels]])
    return made.where("not _edge").drop("_edge").unionByName(edges)


def _changes(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Rows that differ from the one before in one of the columns; the first one does."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = True
    for c in columns:
        codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


class _Sums:
    """Sums of one split over the replicates of a vector."""

    def __init__(self, row: pa.RecordBatch, sims: int, totals: int):
        self.row = self.last = row
        self.sums = np.zeros((sims, totals))
        self.labels = np.zeros(sims, np.int64)
        self.open = np.zeros(sims, np.int64)

    def same(self, batch: pa.RecordBatch, columns: Sequence[str]) -> bool:
        """Whether the batch goes on where the rows so far have ended."""
        return all(self.last.column(c)[0].as_py() == batch.column(c)[0].as_py() for c in columns)

    def add(self, x: np.ndarray, w: np.ndarray, labels: np.ndarray) -> None:
        """Add rows; at ``labels`` new labels begin."""
        odd = ~np.isfinite(x).all(axis=1)
        for i in np.flatnonzero(odd).tolist():  # a row that is not drawn adds nothing
            drawn = w[i] > 0
            self.sums[drawn] += w[i][drawn, None] * x[i][None, :]
        x = np.where(odd[:, None], 0.0, x) if odd.any() else x
        self.sums += w.T.astype(float) @ x
        starts = labels if len(labels) and labels[0] == 0 else np.concatenate([[0], labels])
        drawn = np.add.reduceat(w, starts, axis=0, dtype=np.int64)
        if len(starts) == len(labels):
            self.close()
        else:
            drawn[0] += self.open
        self.labels += (drawn[:-1] > 0).sum(axis=0)
        self.open = drawn[-1]

    def close(self) -> None:
        self.labels += self.open > 0
        self.open = np.zeros_like(self.open)


def _chunks(bounds: np.ndarray, lists: pa.Array, totals: int):
    """(i, j): consecutive splits i to j - 1 to sum together, or one to sum alone, given the
    first row of each and what follows the last."""
    if len(bounds) < 2:
        return
    sizes, i, n = np.diff(lists.offsets.to_numpy())[bounds[0]:bounds[-1]], 0, len(bounds) - 1
    alike = (sizes == sizes[0]).all()  # the last vector of many replicates is shorter
    most = max(PRODUCTS // max(int(sizes.max()) * totals, 1), 1)
    while i < n:
        j = max(int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1, i + 1)
        if j - i > 1 and alike and bounds[j] - bounds[i] <= FEW_ROWS * (j - i):
            yield i, j
        else:
            yield from ((k, k + 1) for k in range(i, j))
        i = j


class _Output:
    """Rows of finished splits, in batches; the first and the last split are edges."""

    def __init__(self, names: Sequence[str], split_by: Sequence[str], whole: Sequence[bool]):
        self.names, self.splits, self.whole = names, list(split_by[:-1]), whole
        self.first, self.rows = True, 0
        self.parts: list[tuple] = []

    def _add(self, keys: pa.RecordBatch, row: np.ndarray, sims: np.ndarray, sums: np.ndarray, labels: np.ndarray, edge: bool):
        at = pa.array(row)
        self.parts.append(([keys.column(s).take(at) for s in self.splits], sims, sums, labels, np.full(len(row), edge)))
        self.rows += len(row)

    def add(self, sums: _Sums, last: bool = False) -> None:
        sums.close()
        drawn = np.flatnonzero(sums.labels)
        first = sums.row.column(FIRST_SIM)[0].as_py()
        self._add(sums.row, np.zeros(len(drawn), np.int64), drawn + first, sums.sums[drawn], sums.labels[drawn],
                  self.first or last)
        self.first = False

    def add_many(self, batch: pa.RecordBatch, bounds: np.ndarray, lists: pa.Array, x: np.ndarray, new_label: np.ndarray) -> None:
        """Splits that begin at ``bounds`` and end where the next one begins."""
        a, b = int(bounds[0]), int(bounds[-1])
        starts, x = bounds[:-1] - a, x[a:b]
        w = lists.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
        with np.errstate(invalid="ignore"):
            products = w[:, :, None].astype(float) * x[:, None, :]
        odd = ~np.isfinite(x).all(axis=1)
        if odd.any():  # a row that is not drawn adds nothing
            products[odd] = np.where(w[odd][:, :, None] > 0, products[odd], 0.0)
        sums = np.add.reduceat(products, starts, axis=0)
        first_row = np.flatnonzero(new_label[a:b])
        drawn = np.add.reduceat(w, first_row, axis=0, dtype=np.int64) > 0
        labels = np.add.reduceat(drawn, np.searchsorted(first_row, starts), axis=0, dtype=np.int64)
        split, at = np.nonzero(labels)
        first = batch.column(FIRST_SIM).to_numpy()[bounds[:-1]][split]
        self._add(batch, bounds[:-1][split], at + first, sums[split, at], labels[split, at], False)

    def flush(self):
        parts, self.parts, self.rows = self.parts, [], 0
        if not parts:
            return
        keys = [pa.concat_arrays(list(k)) for k in zip(*(p[0] for p in parts))]
        sums = np.concatenate([p[2] for p in parts])
        columns = [np.rint(c).astype(np.int64) if w else c for c, w in zip(sums.T, self.whole)]
        yield pa.RecordBatch.from_arrays([
            *keys, pa.array(np.concatenate([p[1] for p in parts]).astype(np.int32)),
            *[pa.array(np.ascontiguousarray(c)) for c in columns], pa.array(np.concatenate([p[3] for p in parts])),
            pa.array(np.concatenate([p[4] for p in parts]))], names=self.names)
