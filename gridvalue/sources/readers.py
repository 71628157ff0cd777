"""Season files: plays, rosters and games in CSV or Parquet; stored results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import union_all

# Column names of the play-by-play, roster and game files.
_INT = ["Season", "Drive", "qtr", "Reception", "QBHit", "InterceptionThrown",
        "Touchdown", "Sack", "Fumble"]
_TEXT = ["posteam", "DefensiveTeam", "HomeTeam", "desc", "PlayType", "Passer",
         "Passer_ID", "Receiver", "Receiver_ID", "Rusher", "Rusher_ID",
         "PassLocation", "RunLocation", "RunGap"]
_NUMBER = ["TimeSecs", "AirYards", "YardsAfterCatch", "Yards_Gained", "EPA", "WPA",
           "airEPA", "airWPA", "yacEPA", "yacWPA"]
PLAYS = {"GameID": T.LongType(), **{c: T.IntegerType() for c in _INT},
         **{c: T.StringType() for c in _TEXT}, **{c: T.DoubleType() for c in _NUMBER}}
PLAY_KEYS = ("GameID", "Season", "Drive", "posteam", "PlayType")
ROSTERS = {"GSIS_ID": T.StringType(), "Pos": T.StringType()}
GAMES = {"GameID": T.LongType(), "Season": T.IntegerType(), "home": T.StringType(),
         "away": T.StringType(), "homescore": T.IntegerType(), "awayscore": T.IntegerType()}


def _typed(raw: DataFrame, columns: dict[str, T.DataType], optional: Iterable[str] = ()) -> DataFrame:
    """Keep the declared columns, cast, with dotted names and empty text repaired.

    Columns named ``optional`` may be absent and are then null; any other absence is
    an error.
    """
    found = {c.replace(".", "_"): c for c in raw.columns}
    absent = [c for c in columns if c not in found and c not in set(optional)]
    if absent:
        raise ValueError(f"columns missing: {', '.join(absent)}")
    out = []
    for name, kind in columns.items():
        if name not in found:
            out.append(F.lit(None).cast(kind).alias(name))
            continue
        c = F.col(f"`{found[name]}`")
        if raw.schema[found[name]].dataType == T.StringType():
            c = F.when(~c.isin("", "NA"), c)
            if isinstance(kind, (T.IntegerType, T.LongType)):
                # Integers may be written as 1.0; others stay exact at any size.
                real = F.when(c.rlike(r"[.eE]"), c.cast("double").cast("long")).otherwise(c.cast("long"))
                c = F.coalesce(c.try_cast("long"), real)
        out.append(c.cast(kind).alias(name))
    return raw.select(*out)


def _read_years(
    spark: SparkSession, template: str, years: Iterable[int],
    columns: dict[str, T.DataType], file_format: str, tag: bool, optional: Iterable[str] = (),
) -> DataFrame:
    frames = []
    for year in years:
        path = template.format(year=year)
        if file_format == "csv":
            raw = spark.read.csv(path, header=True, nullValue="NA", multiLine=False)
        else:
            raw = spark.read.parquet(path)
        frame = _typed(raw, columns, optional)
        frames.append(frame.withColumn("Season", F.lit(int(year))) if tag else frame)
    return union_all(frames)


def load_plays(spark: SparkSession, template: str, years: Iterable[int],
               file_format: str = "csv", optional: Iterable[str] | None = None) -> DataFrame:
    """Plays of the given years; ``template`` holds ``{year}`` in its path.

    Columns named ``optional`` may be absent from the files and are then null: by
    default all but those that tell plays, teams and kinds of play apart.
    """
    optional = [c for c in PLAYS if c not in PLAY_KEYS] if optional is None else optional
    return _read_years(spark, template, years, PLAYS, file_format, False, optional)


def load_rosters(spark: SparkSession, template: str, years: Iterable[int],
                 file_format: str = "csv", by_season: bool = True) -> DataFrame:
    """Distinct (player id, position) pairs of each season, or pooled over all.

    A player whose position changed must be read by season: pooled, both positions
    match the plays of every season.
    """
    return _read_years(spark, template, years, ROSTERS, file_format, tag=by_season).distinct()


def load_games(spark: SparkSession, template: str, years: Iterable[int],
               file_format: str = "csv") -> DataFrame:
    """Final scores of the given years."""
    return _read_years(spark, template, years, GAMES, file_format, tag=False)


def write_season(tables, folder: str, mode: str = "overwrite") -> None:
    """Store the position tables of a run, one partitioned Parquet table each."""
    for name, frame in tables.positions().items():
        parts = [k for k in tables.run_keys if k == "Season"]
        frame.write.mode(mode).partitionBy(*parts).parquet(f"{folder}/{name}")


def read_season(spark: SparkSession, folder: str, years: Iterable[int] | None = None):
    """Position tables stored by :func:`write_season`, pruned to some seasons."""
    from ..operators.tables import PositionTables

    def one(name: str) -> DataFrame:
        frame = spark.read.parquet(f"{folder}/{name}")
        return frame if years is None else frame.where(F.col("Season").isin(list(years)))

    return PositionTables(*[one(n) for n in ("QB", "RB", "WR", "TE")])
