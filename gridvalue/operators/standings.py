"""Game results per team and the price of a win in points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import Tally, ieee_div, if_known
from .preparation import fix_team_code


def team_games(games: DataFrame) -> DataFrame:
    """One row per team and game: score difference and win flag (a tie wins nothing)."""
    diff = F.col("homescore") - F.col("awayscore")
    winner = if_known(diff > 0, F.col("home"), if_known(diff < 0, F.col("away"), F.lit("TIE")))
    sides = F.array(
        F.struct(F.lit("home").alias("Team_Loc"), F.col("home").alias("Team"), diff.alias("Score_Diff")),
        F.struct(F.lit("away").alias("Team_Loc"), F.col("away").alias("Team"), (-diff).alias("Score_Diff")),
    )
    rows = games.select("GameID", "Season", winner.alias("Winner"), F.explode(sides).alias("s"))
    rows = rows.select("GameID", "Season", "Winner", "s.*")
    rows = rows.withColumn(
        "Win_Ind", if_known(F.col("Team") == F.col("Winner"), F.lit(1), F.lit(0))
    )
    return fix_team_code(rows, ["Team"])


def season_summary(games: DataFrame) -> DataFrame:
    """Wins and total score difference per season and team."""
    t = Tally()
    return team_games(games).groupBy("Season", "Team").agg(
        t.strict_total(F.col("Win_Ind")).alias("Wins"),
        t.strict_total(F.col("Score_Diff")).alias("Total_Score_Diff"),
    )


def points_per_win(games: DataFrame, run_keys: Sequence[str] = ()) -> DataFrame:
    """Points of score difference per extra win, pooled or per run key."""
    slope = F.regr_slope("Wins", "Total_Score_Diff")
    return season_summary(games).groupBy(*run_keys).agg(
        ieee_div(F.lit(1.0), slope).alias("points_per_win")
    )
