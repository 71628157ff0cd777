"""Line deduplication over batches, against levelled sorted runs of line hashes.

The state is a set of runs: tables of the 128-bit hashes of the lines seen so far, each
bucketed by hash and sorted within its buckets, with the key of the first document that
holds the line. A new batch reduces its lines to distinct hashes (combined before the
shuffle, so a line of every document is one row a task), merge-anti-joins every run, and
what is left, the lines that are new, becomes a run of level 0. The hashes are shuffled
once for all these joins; the runs lie in place. Once a level has ``FANOUT`` runs, they
are merged into one of the next level, so n batches leave O(log n) runs. A line of the
batch stays if the batch's own run names its document, which is an anti-join on hash and
document: a line of very many documents is spread over as many keys.

Everything is DataFrame functions. Texts are read twice: for the hashes, and to cut the
lines that go, given as positions.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import settle, union_all
from ..functions.storage import shared_folder
from .common import empty_if_null, free_prefix

#: Lines whose key has fewer code points always stay.
LEAST_KEY = 10
FANOUT = 3
BATCHES = 6
#: Keys looked at to cut a table into batches.
SAMPLE = 1000

#: White space stripped from a line, ASCII only, and letters.
SPACE = " \t\n\x0b\f\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case and all else as it is."""
    bare = F.btrim(line, F.lit(SPACE))
    # Lower-casing pure ASCII touches A-Z alone, and is much faster.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, CAPITALS, SMALL))


def line_hashes(docs: DataFrame, least: int = LEAST_KEY) -> DataFrame:
    """(key, mark, pos, h1, h2, ...) of the lines of documents (key, text, ...) that may
    repeat. ``mark`` is a hash of the text, which tells rows of one key apart."""
    rest = [c for c in docs.columns if c not in ("key", "text")]
    body = empty_if_null(F.col("text"))
    lines = docs.select("key", F.xxhash64(body).alias("mark"), *rest,
                        F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
    keyed = lines.select("key", "mark", *rest, "pos", line_key(F.col("line")).alias("line"))
    return keyed.where(F.char_length("line") >= least).select(
        "key", "mark", *rest, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


@dataclass
class Run:
    name: str
    table: DataFrame


class LineRuns:
    """Hashes of the lines of all batches so far, as levelled sorted runs in the shared
    folder; ``levels[i]`` holds the runs of level i, oldest first."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[Run]] = []

    def runs(self) -> list[Run]:
        return [r for level in reversed(self.levels) for r in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch's lines (key, mark, pos, h1, h2) and return (key, mark, pos) of those
        that an earlier batch, or a smaller key of this one, has. Rows with one key must be
        in one batch; a null key is the largest. ``lines`` is read twice: settle it."""
        new = lines.groupBy("h1", "h2").agg(F.min("key").alias("first"))
        for run in self.runs():
            new = new.join(run.table, ["h1", "h2"], "left_anti")
        own = self._write(new)
        holder = own.table.alias("o")
        held = (F.col("l.h1") == F.col("o.h1")) & (F.col("l.h2") == F.col("o.h2")) & (
            F.col("l.key").eqNullSafe(F.col("o.first")))
        gone = settle(lines.alias("l").join(holder, held, "left_anti").select("key", "mark", "pos"), "repeated_lines")
        self._place(own, 0)
        return gone

    def _place(self, run: Run, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(union_all(r.table for r in old))
            for r in old:
                self._drop(r)
            self._place(merged, level + 1)

    def _write(self, rows: DataFrame) -> Run:
        name = f"line_run_{uuid.uuid4().hex}"
        by = ("h1", "h2")
        rows.repartition(self.buckets, *by).write.bucketBy(self.buckets, *by).sortBy(*by).option(
            "path", f"{shared_folder(self.spark)}/{name}").format("parquet").saveAsTable(name)
        return Run(name, self.spark.table(name))

    def _drop(self, run: Run) -> None:
        self.spark.sql(f"DROP TABLE {run.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(self.spark)}/{run.name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Delete all runs."""
        for run in self.runs():
            self._drop(run)
        self.levels = []


def batch_edges(keys: DataFrame, batches: int) -> list:
    """Keys that cut a table into about equal batches in key order, from a bounded sample of
    distinct keys; the sample does not change what is kept."""
    n = keys.agg(F.approx_count_distinct("key")).first()[0]
    share = min(SAMPLE / max(n, 1), 1.0)
    some = keys.where(F.col("key").isNotNull() & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1))
    found = [r["key"] for r in some.distinct().orderBy("key").collect()]
    return [found[len(found) * i // batches] for i in range(1, batches)] if len(found) >= batches else []


def repeated_lines(docs: DataFrame, batches: int = BATCHES, least: int = LEAST_KEY, fanout: int = FANOUT) -> DataFrame:
    """(key, mark, pos) of the lines of documents (key, text) that a smaller key has,
    batch after batch in key order."""
    edges = batch_edges(docs.select("key"), batches)
    batch = F.lit(0)
    for e in edges:
        batch = batch + F.when(F.col("key") < F.lit(e), 0).otherwise(1)
    path = f"{shared_folder(docs.sparkSession)}/lines-{uuid.uuid4().hex}"
    hashed = line_hashes(docs.withColumn("batch", batch), least)
    hashed.write.partitionBy("batch").parquet(path)
    lines = docs.sparkSession.read.schema(hashed.schema).parquet(path)
    state = LineRuns(docs.sparkSession, fanout)
    gone = [state.add(lines.where(F.col("batch") == i).drop("batch")) for i in range(len(edges) + 1)]
    state.clear()
    return union_all(gone)


def cut_lines(docs: DataFrame, gone: DataFrame, key: str, text: str, prefix: str) -> DataFrame:
    """Add n_lines, n_dropped and kept (the text without the lines in ``gone``), their names
    behind the prefix."""
    p = prefix
    body = empty_if_null(F.col(text))
    cuts = gone.groupBy(F.col("key").alias(f"{p}key"), F.col("mark").alias(f"{p}mark")).agg(
        F.sort_array(F.collect_set("pos")).alias(f"{p}cuts"))
    joined = docs.withColumn(f"{p}own", F.xxhash64(body)).join(
        cuts, F.col(key).eqNullSafe(F.col(f"{p}key")) & (F.col(f"{p}own") == F.col(f"{p}mark")), "left")
    lines = joined.withColumn(f"{p}lines", F.split(body, "\n", -1))
    lines = lines.withColumn(f"{p}n_lines", F.size(f"{p}lines").cast("long"))
    lines = lines.withColumn(f"{p}n_dropped", F.coalesce(F.size(f"{p}cuts"), F.lit(0)).cast("long"))
    lines = lines.withColumn(f"{p}edges", F.concat(
        F.array(F.lit(-1)), F.col(f"{p}cuts"), F.array(F.size(f"{p}lines"))))
    # What lies between two cuts, each a slice, in place of a look-up for every line.
    runs = F.transform(F.sequence(F.lit(1), F.size(f"{p}edges") - 1), lambda i: F.slice(
        F.col(f"{p}lines"), F.get(F.col(f"{p}edges"), i - 1) + 2,
        F.get(F.col(f"{p}edges"), i) - F.get(F.col(f"{p}edges"), i - 1) - 1))
    kept = F.when(F.col(f"{p}cuts").isNull(), body).otherwise(F.array_join(F.flatten(runs), "\n"))
    return lines.select(*docs.columns, f"{p}n_lines", f"{p}n_dropped", kept.alias(f"{p}kept"))


def _cut(docs: DataFrame, key: str, text: str, **options) -> tuple[DataFrame, str]:
    p = free_prefix(docs)
    gone = repeated_lines(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), **options)
    return cut_lines(docs, gone, key, text, p), p


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with lines dropped from their texts whose key (at least ``least`` code
    points) a smaller document has; all lines of the smallest one stay.

    Rows with one key are one document, and a null key is the largest. A null text has one
    empty line and stays null. A document may lose all its lines; its text is then empty,
    and the row stays. An empty table stays empty.
    """
    cut, p = _cut(docs, key, text, **options)
    body = F.when(F.col(text).isNotNull(), F.col(f"{p}kept")).alias(text)
    return cut.select(*[body if c == text else F.col(c) for c in docs.columns])


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, n_lines, n_dropped, kept_sha256) of every row, as :func:`drop_repeated_lines`."""
    cut, p = _cut(docs.select(key, text), key, text, **options)
    return cut.select(key, F.col(f"{p}n_lines").alias("n_lines"), F.col(f"{p}n_dropped").alias("n_dropped"),
                      F.sha2(F.col(f"{p}kept"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), marked AS (
    SELECT doc_id, pos, line, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
