"""Player tables per position and player shares of their team's plays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import Tally, ieee_div, null_safe_join, settle
from .splits import passing_splits, receiving_splits, rushing_splits
from .tables import SeasonTables

# Roster positions that share a player table.
BACKS = ("RB", "FB")
NON_QB = ("RB", "WR", "TE")


def table_position(pos: Column) -> Column:
    """The player table a roster position belongs to (null if none)."""
    return (
        F.when(pos.isin(*BACKS), "RB").when(pos.isin("QB", "WR", "TE"), pos)
    )


def _appearances(tables: SeasonTables, extra: Sequence[str] = ()) -> DataFrame:
    """One row per player appearance: passer, receiver or rusher."""
    keep = [*tables.run_keys, *extra]
    if tables.weight:
        keep.append(tables.weight)
    none = F.lit(None).cast("int")

    def role(frame: DataFrame, name: str, kind: str) -> DataFrame:
        table = F.lit("QB") if kind == "pass" else table_position(F.col(f"{name}_Position"))
        if kind == "target":
            table = F.when(table.isin(*NON_QB), table)
        return frame.select(
            *keep,
            F.col(f"{name}_ID_Name").alias("Player_ID_Name"),
            table.alias("Position"),
            F.lit(kind).alias("kind"),
            (F.col("Reception") if kind == "target" else none).alias("Reception"),
            (F.col("Sack") if kind == "rush" else none).alias("Sack"),
        ).where(F.col("Position").isNotNull())

    frames = [
        role(tables.passing, "Passer", "pass"),
        role(tables.passing, "Receiver", "target"),
        role(tables.rushing, "Rusher", "rush"),
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def _counts(tables: SeasonTables, keys: Sequence[str]) -> DataFrame:
    """Attempts of each player, all positions in one aggregation."""
    t = Tally(tables.weight)
    rows = _appearances(tables, [k for k in keys if k not in tables.run_keys])
    kind = F.col("kind")

    def strict(x: str, of: str) -> Column:
        known = F.count_if((kind == of) & F.col(x).isNull()) == 0
        return F.when(known, t.total(F.col(x))).cast("long")

    return rows.groupBy(*tables.run_keys, *[k for k in keys if k not in tables.run_keys],
                        "Player_ID_Name", "Position").agg(
        t.rows_where(kind == "pass").alias("Pass_Attempts"),
        strict("Reception", "target").alias("Receptions"),
        t.rows_where(kind == "target").alias("Targets"),
        t.rows_where(kind == "rush").alias("_rushes"),
        strict("Sack", "rush").alias("Sacks"),
    )


def player_counts(tables: SeasonTables) -> DataFrame:
    """Attempts per player and position table; unknown sums count as zero."""
    c = F.col
    known = {n: F.coalesce(c(n), F.lit(0)) for n in ("Receptions", "Sacks")}
    # Passers' rushes exclude sacks and are unknown when a sack flag is.
    qb_rush = F.coalesce(c("_rushes") - c("Sacks"), F.lit(0))
    out = _counts(tables, tables.run_keys).withColumns({
        **known, "Rush_Attempts": F.when(c("Position") == "QB", qb_rush).otherwise(c("_rushes")),
    })
    qb_total = c("Pass_Attempts") + c("Rush_Attempts") + c("Sacks")
    other_total = c("Receptions") + c("Targets") + c("Rush_Attempts")
    return out.withColumn(
        "Total_Plays", F.when(c("Position") == "QB", qb_total).otherwise(other_total)
    )


def _one_position(counts: DataFrame, run_keys: Sequence[str], position: str) -> DataFrame:
    attempts = (
        ["Pass_Attempts", "Rush_Attempts", "Sacks"] if position == "QB"
        else ["Receptions", "Targets", "Rush_Attempts"]
    )
    return counts.where(F.col("Position") == position).select(
        *run_keys, "Player_ID_Name", "Position", *attempts, "Total_Plays"
    )


def qb_table(tables: SeasonTables) -> DataFrame:
    return _one_position(player_counts(tables), tables.run_keys, "QB")


def position_table(tables: SeasonTables, position: str) -> DataFrame:
    """RB (with FB), WR or TE table."""
    if position not in NON_QB:
        raise ValueError(f"position: {position!r}")
    return _one_position(player_counts(tables), tables.run_keys, position)


def add_position_tables(tables: SeasonTables) -> SeasonTables:
    """All four player tables from one aggregation over the plays."""
    counts = settle(player_counts(tables), "player_counts")
    return tables.with_positions(
        {p: _one_position(counts, tables.run_keys, p) for p in ("QB", *NON_QB)}
    )


def adj_net_yards() -> Column:
    """Adjusted net yards per attempt, with sacks counted as attempts."""
    c = F.col
    gained = c("Pass_Yards_Gained") + 20 * c("Pass_TDs") - 45 * c("INTs") + c("Sack_Yards_Lost")
    return ieee_div(gained, c("Pass_Attempts") + c("Sacks"))


def join_position_statistics(tables: SeasonTables) -> SeasonTables:
    """Attach split statistics to the player tables; missing and NaN become 0."""
    keys, w = list(tables.run_keys), tables.weight

    def stats(split, plays, label_col: str, drop: list[str]) -> DataFrame:
        out = split(plays, [*keys, label_col], weight=w).drop(*drop)
        return out.withColumnRenamed(label_col, "Player_ID_Name")

    passing = stats(passing_splits, tables.passing, "Passer_ID_Name", ["Pass_Attempts"])
    receiving = stats(receiving_splits, tables.passing, "Receiver_ID_Name", ["Targets"])
    receiving = receiving.withColumnRenamed("Receptions", "Receptions_stat")
    rushing = stats(rushing_splits, tables.rushing, "Rusher_ID_Name", ["Rushes", "Sacks"])
    # The three non-QB tables read the receiving and rushing statistics.
    receiving, rushing = settle(receiving, "receiving"), settle(rushing, "rushing_stats")
    on = [*keys, "Player_ID_Name"]

    def attach(position: str, table: DataFrame) -> DataFrame:
        first = passing if position == "QB" else receiving
        out = table.join(first, on, "left").join(rushing, on, "left")
        if position == "QB":
            out = out.withColumn("AdjNetYardsAtt", adj_net_yards())
        numbers = [f.name for f in out.schema if f.dataType != T.StringType()]
        return out.na.fill(0, [n for n in numbers if n not in keys])

    return tables.map_positions(attach)


def _with_team_shares(counts: DataFrame, run_keys: Sequence[str], attempts: Sequence[str]) -> DataFrame:
    """Team totals and the player's share of each kind of attempt.

    Totals are aggregated and joined back rather than windowed, so a team with
    many players is not gathered in one task.
    """
    counts = settle(counts, "player_team")
    keys = [*run_keys, "posteam"]
    named = {a: f"Team_{a}" for a in attempts}
    totals = counts.groupBy(*keys).agg(*[F.sum(a).alias(n) for a, n in named.items()])
    totals = totals.withColumn(
        "Team_Total_Plays", sum((F.col(n) for n in named.values()), F.lit(0))
    )
    joined = null_safe_join(counts, settle(totals, "team_totals"), keys)
    return joined.withColumns({
        f"Perc_{a}": ieee_div(F.col(a), F.col(f"Team_{a}")) for a in [*attempts, "Total_Plays"]
    })


def qb_team_table(tables: SeasonTables) -> DataFrame:
    """Attempts and team shares of each quarterback on each team."""
    c = F.col
    counts = _counts(tables, [*tables.run_keys, "posteam"]).where(c("Position") == "QB")
    counts = counts.withColumn("Rush_Attempts", F.coalesce(c("_rushes") - c("Sacks"), F.lit(0)))
    counts = counts.withColumn("Sacks", F.coalesce("Sacks", F.lit(0)))
    kinds = ["Pass_Attempts", "Rush_Attempts", "Sacks"]
    counts = counts.withColumn("Total_Plays", c("Pass_Attempts") + c("Rush_Attempts") + c("Sacks"))
    counts = counts.select(*tables.run_keys, "Player_ID_Name", "posteam", *kinds, "Total_Plays", "Position")
    return _with_team_shares(counts, tables.run_keys, kinds)


def pos_team_table(tables: SeasonTables, position: str) -> DataFrame:
    """Targets, rushes and team shares of each player of a position on each team.

    ``RB`` and ``FB`` mean both, ``WR`` means itself, anything else means TE; the
    Position column repeats the argument.
    """
    c = F.col
    group = "RB" if position in BACKS else position if position == "WR" else "TE"
    counts = _counts(tables, [*tables.run_keys, "posteam"]).where(c("Position") == group)
    kinds = ["Targets", "Rush_Attempts"]
    counts = counts.withColumnRenamed("_rushes", "Rush_Attempts").withColumn(
        "Total_Plays", c("Targets") + c("Rush_Attempts")
    )
    counts = counts.select(*tables.run_keys, "Player_ID_Name", "posteam", *kinds, "Total_Plays",
                           F.lit(position).alias("Position"))
    return _with_team_shares(counts, tables.run_keys, kinds)
