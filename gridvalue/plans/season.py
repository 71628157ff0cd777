"""Whole-season pipelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import PLAYS_CODEC, settle
from ..operators.bootstrap import each_replicate, simulate_seasons
from ..operators.effects import EP_MODELS, WP_MODELS, MixedSpec
from ..operators.positions import add_position_tables, join_position_statistics
from ..operators.preparation import (
    add_positions, add_results, add_situation, fix_team_code, pass_plays, rush_plays, with_team_rates,
)
from ..operators.replacement import (
    DEFAULT_RULES, Rule, find_replacement_level, reuse_replacement_level,
)
from ..operators.standings import points_per_win
from ..operators.replicates import FIRST_SIM, WEIGHTS
from ..operators.tables import PositionTables, SeasonTables
from ..operators.value import (
    above_replacement, estimate_value_added, points_to_wins, prob_to_wins,
)


def model_plays(
    plays: DataFrame, rosters: DataFrame, run_keys: Sequence[str] = ("Season",),
    drop: Sequence[str] = (),
) -> DataFrame:
    """Plays with identities, positions and covariates, written once.

    Columns of ``drop``, which no later stage reads, are left out of the joins and the
    written table where they can be. Flags are read before the joins, which then need not
    carry the texts.
    """
    flagged = add_situation(fix_team_code(plays))
    flags = [c for c in flagged.columns if c not in plays.columns]
    placed = add_positions(flagged, rosters, run_keys)
    placed = placed.select(*placed.drop(*flags).columns, *flags)
    return settle(add_results(placed).drop(*drop), "model_plays", codec=PLAYS_CODEC)


# The columns the pipeline reads from passing and rushing plays.
_BOTH = ["GameID", "Drive", "posteam", "DefensiveTeam", "Home_Ind", "Shotgun_Ind",
         "No_Huddle_Ind", "Yards_Gained", "Touchdown", "EPA", "WPA"]
_PASSING = ["qtr", "TimeSecs", "Passer_ID_Name", "Receiver_ID_Name", "Receiver_Position",
            "PassLocation", "Reception", "AirYards", "YardsAfterCatch", "QBHit",
            "InterceptionThrown", "airEPA", "airWPA", "yacEPA", "yacWPA", "airEPA_Result",
            "airWPA_Result", "yacEPA_Result", "yacWPA_Result"]
_RUSHING = ["Rusher_ID_Name", "Rusher_Position", "Team_Side_Gap", "Sack", "Fumble"]


def season_tables(
    plays: DataFrame, run_keys: Sequence[str] = ("Season",), weight: str | None = None,
    specs: Mapping[str, MixedSpec] | None = None,
) -> SeasonTables:
    """Player tables and modelling plays, written with the columns later stages read.

    ``specs`` adds the columns its models use, if the plays have them. Plays with weight
    vectors are written as such, and replicates told apart when they are read.
    """
    extra = {c for spec in (specs or {}).values() for c in spec.columns()} & set(plays.columns)

    def written(frame: DataFrame, columns: list[str], name: str) -> DataFrame:
        keep = dict.fromkeys([*run_keys, *([weight] if weight else []), *_BOTH, *columns, *sorted(extra)])
        if WEIGHTS not in frame.columns:
            return settle(frame.select(*keep), name, codec=PLAYS_CODEC)
        own = [c for c in keep if c in frame.columns]
        return each_replicate(settle(frame.select(*own, FIRST_SIM, WEIGHTS), name, codec=PLAYS_CODEC)).select(*keep)

    passing = written(pass_plays(plays), _PASSING, "passing")
    rushing = written(rush_plays(plays), _RUSHING, "rushing")
    return add_position_tables(with_team_rates(passing, rushing, run_keys, weight))


def wins_from_probability(
    plays: DataFrame, run_keys: Sequence[str] = ("Season",),
    rules: Mapping[str, Rule] = DEFAULT_RULES, specs: Mapping[str, MixedSpec] = WP_MODELS,
    statistics: bool = True, **options,
) -> SeasonTables:
    """Season WAR on the win-probability scale, with split statistics."""
    tables = season_tables(plays, run_keys, specs=specs)
    if statistics:
        tables = join_position_statistics(tables)
    tables = find_replacement_level(tables, rules)
    return prob_to_wins(above_replacement(estimate_value_added(tables, specs, **options)))


def wins_from_points(
    plays: DataFrame, games: DataFrame, run_keys: Sequence[str] = ("Season",),
    rules: Mapping[str, Rule] = DEFAULT_RULES, specs: Mapping[str, MixedSpec] = EP_MODELS,
    **options,
) -> SeasonTables:
    """Season WAR on the expected-points scale, priced per season."""
    tables = season_tables(plays, run_keys, specs=specs)
    tables = find_replacement_level(tables, rules)
    tables = above_replacement(estimate_value_added(tables, specs, **options))
    seasons = plays.select("Season").distinct()
    played = games.join(seasons, "Season", "left_semi")
    if "Season" in run_keys:
        return points_to_wins(tables, settle(points_per_win(played, ["Season"]), "points_per_win"))
    return points_to_wins(tables, points_per_win(played).first()["points_per_win"])


def bootstrap_wins(
    plays: DataFrame, stored: PositionTables, n_sims: int, run_keys: Sequence[str] = ("Season",),
    specs: Mapping[str, MixedSpec] = WP_MODELS, seed: int = 0, drive_level: bool = True,
    sims_per_batch: int = 100, statistics: bool = True, statistics_first: bool = False, **options,
) -> PositionTables:
    """WAR of every replicate, with the replacement players of a stored season.

    Plays are relabelled before statistics are joined, as documented, which zeroes
    the statistics of replacement players; ``statistics_first`` keeps them.
    """
    def one(drawn: DataFrame, keys: tuple[str, ...], weight: str) -> SeasonTables:
        tables = season_tables(drawn, keys, weight, specs)
        if statistics and statistics_first:
            tables = join_position_statistics(tables)
        tables = reuse_replacement_level(tables, stored)
        if statistics and not statistics_first:
            tables = join_position_statistics(tables)
        tables = estimate_value_added(tables, specs, return_models=False, **options)
        return prob_to_wins(above_replacement(tables))

    return simulate_seasons(plays, n_sims, one, run_keys, seed, drive_level, sims_per_batch, packed=True)


def all_positions(tables: SeasonTables | PositionTables, columns: Sequence[str]) -> DataFrame:
    """The named columns of all four position tables, one below the other."""
    out = None
    for frame in tables.positions().values():
        part = frame.select(*[F.col(c) for c in columns])
        out = part if out is None else out.unionByName(part)
    return out
