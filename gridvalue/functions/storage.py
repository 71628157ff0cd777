"""Written intermediate tables.

A settled table is Parquet in the folder the cluster shares. Writing it cuts
the lineage (a lost executor costs only the tasks it was running), lets several
stages read it column-pruned, and tells Catalyst its true size: a join with it
is broadcast only if that size is below ``spark.sql.autoBroadcastJoinThreshold``
(see :func:`join_side` for tables of many small rows) and is a sort-merge join, with
adaptive skew splitting, otherwise. The engine
therefore never forces a broadcast.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .semantics import null_safe_join

#: Rows of a written table up to which a join may broadcast it.
BROADCAST_ROWS = 500_000

#: Compression of tables of plays, which are most of what is written.
PLAYS_CODEC = "zstd"

#: Byte codes of a method up to which HotSpot compiles it.
COMPILED_METHOD = 8000

_local_folders: dict[str, tempfile.TemporaryDirectory] = {}
#: Folders of the open scopes of this thread or task context, innermost last.
_open_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("open_scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """Folder for written tables: ``spark.checkpoint.dir``, or a temporary one
    when that is unset and the session is local."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder that all executors share"
            )
        if sc.applicationId not in _local_folders:
            _local_folders[sc.applicationId] = tempfile.TemporaryDirectory(
                prefix="gridvalue-"
            )
        folder = _local_folders[sc.applicationId].name
    return f"{folder.rstrip('/')}/gridvalue/{sc.applicationId}"


def settle(df: DataFrame, name: str, keep: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` once and return the written table.

    Inside :func:`scratch_tables` the table is deleted at the end, unless ``keep``.
    ``codec`` compresses it, by default as the session says.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, name, keep, codec))


def _write(df: DataFrame, name: str, keep: bool = False, codec: str | None = None, by: tuple[str, ...] = ()) -> str:
    """Write ``df`` to a new folder, one subfolder per value of ``by``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _open_scopes.get()
    if scopes and not keep:
        scopes[-1].append(path)
    with compiled_methods(spark):
        (df.write.option("compression", codec) if codec else df.write).partitionBy(*by).parquet(path)
    return path


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Stages run inside whose code makes one method that HotSpot would interpret run by
    operators instead, as wide rows of many expressions do several times faster."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), COMPILED_METHOD))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def join_side(table: DataFrame) -> DataFrame:
    """A written table as one side of a join, merged and not broadcast if it has many rows.

    Spark goes by the size of the files, and rows take some twenty times that in the
    memory of the driver, which builds a broadcast.
    """
    return table if table.count() <= BROADCAST_ROWS else table.hint("merge")


#: Keys with most rows whose rows :func:`attach` leaves where they are.
FREQUENT_KEYS = 1000


def attach(rows: DataFrame, table: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """``null_safe_join(rows, table, on)`` with a written table, which shuffles fewer rows.

    A table of many rows is merged, but not for the keys with most rows, such as the one of
    nobody: what the table holds for these few is broadcast. Then ``rows`` is read several
    times.
    """
    side = join_side(table)
    if side is table:
        return null_safe_join(rows, table, on)
    most = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n")).limit(FREQUENT_KEYS)
    most = settle(most.drop("_n"), "frequent_keys")
    held = null_safe_join(table, most, {t: r for r, t in on.items()}, "left_semi")
    few = settle(null_safe_join(most, settle(held, "frequent_held"), on), "frequent_rows")
    other = null_safe_join(rows, most, list(on), "left_anti")
    return null_safe_join(rows, few, list(on), "inner").unionByName(null_safe_join(other, side, on))


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables settled inside, once their results are written."""
    own: list[str] = []
    token = _open_scopes.set((*_open_scopes.get(), own))
    try:
        yield
    finally:
        _open_scopes.reset(token)
        for path in own:
            _delete(spark, path)


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _delete(spark: SparkSession, folder: str) -> None:
    files, path = _file_system(spark, folder)
    files.delete(path, True)


def settle_parts(parts: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """Write several frames of one schema in a single job; return each of them.

    Each is a folder of its own, so that a join with a small one goes by its own size.
    """
    tagged = None
    for key, frame in parts.items():
        t = frame.withColumn("part", F.lit(key))
        tagged = t if tagged is None else tagged.unionByName(t)
    spark, path = tagged.sparkSession, _write(tagged, name, by=("part",))
    schema = tagged.drop("part").schema

    def read(folder: str) -> DataFrame:
        files, at = _file_system(spark, folder)
        return spark.read.schema(schema).parquet(folder) if files.exists(at) else spark.createDataFrame([], schema)

    return {k: read(f"{path}/part={k}") for k in parts}


def spread(df: DataFrame) -> DataFrame:
    """Deal out a table that is stored in fewer pieces than there are cores.

    Large tables come in many pieces and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def clear_settled(spark: SparkSession) -> None:
    """Delete every table this application has settled."""
    _delete(spark, shared_folder(spark))
