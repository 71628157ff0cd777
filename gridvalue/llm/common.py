"""Helpers that several operators share: Arrow text buffers, bounded slices, schemas."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Module that holds what a Python worker keeps from task to task.
WORKER_STATE = "_gridvalue_worker"

#: Bytes of text that a task works on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_column(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; a null is empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    if pa.types.is_large_string(arr.type):
        _, offsets, data = arr.buffers()
        kind = np.int64
    else:
        arr = arr.cast(pa.string())
        _, offsets, data = arr.buffers()
        kind = np.int32
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES,
           rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with at most ``limit`` bytes of text, one row at least, and no
    more than ``rows`` rows."""
    _, at = text_column(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(int(np.searchsorted(at, at[start] + limit, "right")) - 1, start + 1)
        end = min(end, start + rows) if rows else end
        yield batch.slice(start, end - start)
        start = end


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    arrays = {n: batch.column(n) for n in batch.schema.names if n not in new}
    return pa.RecordBatch.from_arrays(
        [*arrays.values(), *new.values()], names=[*arrays, *new])


def add_by_slice(
    df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    fields: dict[str, T.DataType], drop: tuple[str, ...] = (), rows: int | None = None,
) -> DataFrame:
    """Add columns that ``fn`` computes from bounded slices of rows.

    Columns of the frame with the new names are replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in fields and f.name not in drop]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in fields.items())])
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, rows=rows):
                out = with_columns(part, fn(part))
                yield out.select(names)
        give_back()

    return df.mapInArrow(run, schema)


def drop_worker_state() -> None:
    """Forget what tasks of another operator keep in this Python worker, such as a cache
    of words; they make it anew when they come again."""
    sys.modules.pop(WORKER_STATE, None)


def give_back() -> None:
    """Return free memory to the system at the end of a task, for as long as its worker
    waits for the next one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of the frame starts with."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def empty_if_null(c) -> Column:
    return F.coalesce(c, F.lit(""))
