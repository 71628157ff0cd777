"""Registered queries: every operator run over whole driver tables.

Each takes (spark, folder of Parquet tables) and returns a DataFrame. Stages that
many queries share (plays, modelling plays, player tables, fits) are written once
per session and folder, as the season pipeline itself does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import PLAYS_CODEC, compiled_methods, label, settle, shared_folder, union_all
from .operators import bootstrap as boot
from .operators import effects, positions, preparation, reliability, replacement, splits
from .operators import standings, value
from .operators.tables import PositionTables, SeasonTables
from .plans import season
from .sources import (
    games_from_tables, load_games, load_plays, load_rosters, plays_from_tables, read_season,
    rosters_from_tables, write_season,
)

SEED = 7
SIMS = 4
THETA = 0.25
RATIOS = (0.25, 0.2, 0.1)
PLAY_ORDER = ["GameID", "Drive", "qtr", "TimeSecs", "DefensiveTeam", "PlayType", "Passer_ID",
              "Receiver_ID", "Rusher_ID", "Yards_Gained", "EPA", "AirYards", "Reception"]

#: Texts that no query reads once plays have names and flags.
RAW_TEXT = ("Passer", "Receiver", "Rusher", "desc", "HomeTeam", "RunLocation")

_stages: dict[tuple, object] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _stage(fn):
    """Build a shared stage once per application and data folder."""
    @wraps(fn)
    def inner(spark: SparkSession, sf: str):
        key = (spark.sparkContext.applicationId, sf, fn.__name__)
        if key not in _stages:
            _stages[key] = fn(spark, sf)
        return _stages[key]
    return inner


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def named(name: str):
    """Register under a name that an import of this module already uses."""
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


@_stage
def raw_plays(spark, sf) -> DataFrame:
    return settle(plays_from_tables(spark, sf), "plays", codec=PLAYS_CODEC)


@_stage
def model_plays(spark, sf) -> DataFrame:
    return season.model_plays(raw_plays(spark, sf), rosters_from_tables(spark, sf), drop=RAW_TEXT)


@_stage
def tables(spark, sf) -> SeasonTables:
    """Modelling plays and player tables."""
    return season.season_tables(model_plays(spark, sf))


@_stage
def pooled(spark, sf) -> SeasonTables:
    """The same after pooling replacement players."""
    out = replacement.find_replacement_level(tables(spark, sf))
    out = replace(out, **{k: settle(getattr(out, k), k, codec=PLAYS_CODEC) for k in ("passing", "rushing")})
    return out.map_positions(lambda p, t: settle(t, f"flagged_{p}"))


@_stage
def oneway_fits(spark, sf) -> DataFrame:
    """One-way effects with a given sd ratio, in the layout of the season models."""
    t = pooled(spark, sf)
    rush = effects.rushing_inputs(t.rushing)

    def spec(response: str, group: str) -> effects.MixedSpec:
        return effects.MixedSpec(response, groups=(group,))

    parts = {
        "air": (t.passing, spec("airWPA_Result", "Passer_ID_Name")),
        "yac": (t.passing, spec("yacWPA_Result", "Passer_ID_Name")),
        "air/rec": (t.passing, spec("airWPA_Result", "Receiver_ID_Name")),
        "yac/rec": (t.passing, spec("yacWPA_Result", "Receiver_ID_Name")),
        "qb_rush": (rush["qb_rush"], spec("WPA", "Rusher_ID_Name")),
        "main_rush": (rush["main_rush"], spec("WPA", "Rusher_ID_Name")),
    }
    out = effects.crossed_effects(parts, t.run_keys, theta={m: [THETA] for m in parts})
    return settle(out.withColumn("model", F.split("model", "/")[0]), "oneway")


@_stage
def season_fits(spark, sf) -> DataFrame:
    return settle(effects.fit_season_models(pooled(spark, sf)), "fits")


@_stage
def given_fits(spark, sf) -> DataFrame:
    """The season's crossed models at given sd ratios of their grouping factors."""
    theta = {m: RATIOS[:len(spec.groups)] for m, spec in effects.WP_MODELS.items()}
    return settle(effects.fit_season_models(pooled(spark, sf), theta=theta), "given")


@_stage
def season_results(spark, sf) -> SeasonTables:
    """Stored season: win-probability WAR with statistics."""
    # Rules read attempts, which statistics leave alone, so players are flagged once for all queries.
    flagged = pooled(spark, sf)
    own = tables(spark, sf).with_positions(flagged.positions())
    t = positions.join_position_statistics(own)
    t = replace(t, passing=flagged.passing, rushing=flagged.rushing)
    t = value.add_value(t, season_fits(spark, sf))
    t = value.prob_to_wins(value.above_replacement(t))
    return t.map_positions(lambda p, x: settle(x, f"season_{p}"))


def _stored(t: SeasonTables) -> PositionTables:
    return PositionTables(t.qb, t.rb, t.wr, t.te)


def _years(spark, sf) -> list[int]:
    rows = games_from_tables(spark, sf).select("Season").distinct().collect()
    return sorted(r["Season"] for r in rows)


def rounded(df: DataFrame, columns: list[str] | None = None, digits: int = 10) -> DataFrame:
    """Round doubles whose last bits depend on the order of addition.

    A shift far below the last digit keeps exact halves off the rounding edge.
    """
    names = columns or [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    shift = F.lit(10.0 ** -(digits + 3))
    return df.withColumns({n: F.round(F.col(n) + shift, digits) for n in names})


# --- sources and sinks -------------------------------------------------------

def _exported(spark, df: DataFrame, name: str, rename: dict[str, str] | None = None) -> str:
    """Write one CSV folder per season; return the path template."""
    folder = f"{shared_folder(spark)}/export-{name}"
    out = df.withColumn("year", F.col("Season"))
    out = out.withColumnsRenamed(rename or {})
    with compiled_methods(spark):
        out.write.mode("overwrite").partitionBy("year").option("header", True).csv(folder)
    return folder + "/year={year}"


@named("load_plays")
def load_plays_csv(spark, sf):
    template = _exported(spark, raw_plays(spark, sf), "plays", {"Yards_Gained": "Yards.Gained"})
    return load_plays(spark, template, _years(spark, sf))


@named("load_rosters")
def load_rosters_csv(spark, sf):
    listed = rosters_from_tables(spark, sf)
    years = F.array(*[F.lit(y) for y in _years(spark, sf)])
    template = _exported(spark, listed.withColumn("Season", F.explode(years)), "rosters")
    return load_rosters(spark, template, _years(spark, sf), by_season=False)


@named("load_games")
def load_games_csv(spark, sf):
    template = _exported(spark, games_from_tables(spark, sf), "games")
    return load_games(spark, template, _years(spark, sf))


@query
def write_read_season(spark, sf):
    folder = f"{shared_folder(spark)}/stored-season"
    write_season(pooled(spark, sf), folder)
    back = read_season(spark, folder)
    cols = ["Season", "Player_ID_Name", "Position", "Total_Plays"]
    return season.all_positions(back, cols)


# --- preparation -------------------------------------------------------------

@query
def fix_team_code(spark, sf):
    renames = (("GERMANY", 1995, "GER"), ("FRANCE", 1997, "FRA"))
    out = preparation.fix_team_code(raw_plays(spark, sf), renames=renames)
    return out.groupBy("Season", "posteam", "DefensiveTeam").agg(F.count(F.lit(1)).alias("n"))


@query
def common_name(spark, sf):
    names = preparation.name_tables(raw_plays(spark, sf))
    return union_all(n.withColumn("role", F.lit(r)) for r, n in names.items())


@query
def id_name(spark, sf):
    out = preparation.id_name(raw_plays(spark, sf))
    return out.groupBy("Season", "Passer_ID_Name", "Receiver_ID_Name", "Rusher_ID_Name").agg(
        F.count(F.lit(1)).alias("n"))


@query
def sack_as_rush(spark, sf):
    out = preparation.sack_as_rush(preparation.id_name(raw_plays(spark, sf)))
    return out.groupBy("Season", "PlayType", "Rusher_ID", "Rusher", "Rusher_Name",
                       "Rusher_ID_Name").agg(F.count(F.lit(1)).alias("n"))


@query
def add_positions(spark, sf):
    out = preparation.add_positions(raw_plays(spark, sf), rosters_from_tables(spark, sf))
    return out.select("Season", "GameID", "Drive", "PlayType", "Passer_ID_Name", "Receiver_ID_Name",
                      "Rusher_ID_Name", "Passer_Position", "Receiver_Position", "Rusher_Position")


@query
def add_positions_by_season(spark, sf):
    """Rosters of each season: receivers change position from odd to even seasons."""
    plays = raw_plays(spark, sf)
    even = (F.col("Season") % 2 == 0) & (F.col("Pos") == "WR")
    rosters = rosters_from_tables(spark, sf).withColumn(
        "Season", F.explode(F.array(*[F.lit(y) for y in _years(spark, sf)]))).withColumn(
        "Pos", F.when(even, "TE").otherwise(F.col("Pos")))
    out = preparation.add_positions(plays, rosters)
    return out.groupBy("Season", "Receiver_Position").agg(F.count(F.lit(1)).alias("plays"))


@query
def model_vars(spark, sf):
    return model_plays(spark, sf).select(
        "Season", "GameID", "Drive", "Shotgun_Ind", "No_Huddle_Ind", "Home_Ind", "airEPA_Result",
        "airWPA_Result", "yacEPA_Result", "yacWPA_Result", "RunGap", "Team_Side_Gap")


@query
def pass_plays(spark, sf):
    return preparation.pass_plays(model_plays(spark, sf)).select(
        "Season", "GameID", "Drive", "posteam", "Passer_ID_Name", "Receiver_ID_Name",
        "Receiver_Position", "EPA", "WPA")


@query
def rush_plays(spark, sf):
    return preparation.rush_plays(model_plays(spark, sf)).select(
        "Season", "GameID", "Drive", "posteam", "Rusher_ID_Name", "Rusher_Position", "EPA", "WPA")


@query
def team_rates(spark, sf):
    plays = model_plays(spark, sf)
    return preparation.team_rates(preparation.pass_plays(plays), preparation.rush_plays(plays))


@query
def prepare_model_data(spark, sf):
    t = preparation.prepare_model_data(model_plays(spark, sf))
    rates = [f"{k}_{m}" for k in ("Pass", "Rush") for m in ("EPA_Att", "WPA_Att", "Attempts")]
    keep = ["Season", "GameID", "Drive", "posteam", "PlayType", "EPA", *rates]
    return t.passing.select(*keep).unionByName(t.rushing.select(*keep))


@query
def team_games(spark, sf):
    return standings.team_games(games_from_tables(spark, sf))


@query
def season_summary(spark, sf):
    return standings.season_summary(games_from_tables(spark, sf))


# --- split statistics --------------------------------------------------------

@query
def passing_splits(spark, sf):
    out = splits.passing_splits(tables(spark, sf).passing, ["Season", "Passer_ID_Name"])
    return rounded(out, ["Passer_Rating"])


@query
def passing_splits_by_team_and_quarter(spark, sf):
    out = splits.passing_splits(tables(spark, sf).passing, ["Season", "posteam", "qtr"])
    return rounded(out, ["Passer_Rating"])


@query
def receiving_splits(spark, sf):
    return splits.receiving_splits(tables(spark, sf).passing, ["Season", "Receiver_ID_Name"])


@query
def rushing_splits(spark, sf):
    return splits.rushing_splits(tables(spark, sf).rushing, ["Season", "Rusher_ID_Name"])


@query
def game_drive(spark, sf):
    keyed = tables(spark, sf).passing.select("Season", "posteam", label("GameID", "Drive").alias("d"))
    return keyed.groupBy("Season", "posteam").agg(F.count_distinct("d").alias("drives"))


@query
def position_stats(spark, sf):
    qb = positions.join_position_statistics(tables(spark, sf)).qb
    return rounded(qb, ["Passer_Rating"])


@query
def position_stats_receivers(spark, sf):
    t = positions.join_position_statistics(tables(spark, sf))
    return union_all([t.rb, t.wr, t.te])


@query
def adj_net_yards(spark, sf):
    qb = positions.join_position_statistics(tables(spark, sf)).qb
    return qb.select("Season", "Player_ID_Name", "AdjNetYardsAtt")


# --- player and share tables -------------------------------------------------

@query
def qb_table(spark, sf):
    return positions.qb_table(tables(spark, sf))


@query
def rb_table(spark, sf):
    return positions.position_table(tables(spark, sf), "RB")


@query
def wr_table(spark, sf):
    return positions.position_table(tables(spark, sf), "WR")


@query
def te_table(spark, sf):
    return positions.position_table(tables(spark, sf), "TE")


@query
def add_position_tables(spark, sf):
    t = positions.add_position_tables(tables(spark, sf))
    cols = ["Season", "Player_ID_Name", "Position", "Rush_Attempts", "Total_Plays"]
    return season.all_positions(t, cols)


@query
def qb_team_table(spark, sf):
    return positions.qb_team_table(tables(spark, sf))


@query
def pos_team_table(spark, sf):
    return union_all(positions.pos_team_table(tables(spark, sf), p) for p in ("RB", "WR", "TE"))


# --- replacement level -------------------------------------------------------

def _ruled(spark, sf, rules: dict[str, replacement.Rule]) -> DataFrame:
    t = tables(spark, sf)
    return union_all(rule(t).withColumn("rule", F.lit(name)) for name, rule in rules.items())


@query
def roster_replacement(spark, sf):
    rule = replacement.roster_replacement
    return _ruled(spark, sf, {
        "QB": rule(3, "QB", "pass"), "RB_rush": rule(3, ["RB", "FB"], "rush"),
        "WR_rec": rule(4, ["WR"], "pass"),
    })


@query
def league_replacement(spark, sf):
    rule = replacement.league_replacement
    return _ruled(spark, sf, {
        "QB": rule(1, "QB", "Pass_Attempts"), "RB": rule(3, "RB", "Rush_Attempts"),
        "WR": rule(4, "WR", "Targets"), "TE": rule(2, "TE", "Targets"),
        "WR_TE": rule(1, "WR", "Rush_Attempts", combine_wrte=True),
        "short": rule(500, "TE", "Targets"),
    })


@query
def pct_replacement(spark, sf):
    team = positions.qb_team_table(tables(spark, sf))
    return replacement.percentage_replacement_of(team, "Perc_Pass_Attempts", 0.2)


@query
def pct_replacement_fn(spark, sf):
    return replacement.percentage_replacement("Perc_Total_Plays", 0.1)(tables(spark, sf))


@query
def game_one_replacement(spark, sf):
    return replacement.game_one_replacement()(tables(spark, sf))


def _relabelled_counts(t: SeasonTables) -> DataFrame:
    n = F.count(F.lit(1)).alias("n")
    a = t.passing.groupBy("Season", F.col("Passer_ID_Name").alias("first"),
                          F.col("Receiver_ID_Name").alias("second")).agg(n)
    b = t.rushing.groupBy("Season", F.col("Rusher_ID_Name").alias("first"),
                          F.lit(None).cast("string").alias("second")).agg(n)
    return a.unionByName(b)


@query
def apply_replacement(spark, sf):
    return _relabelled_counts(replacement.find_replacement_level(tables(spark, sf)))


@query
def apply_replacement_tables(spark, sf):
    t = replacement.find_replacement_level(tables(spark, sf))
    cols = ["Season", "Player_ID_Name", "Position", "Replacement_Level_Receiver",
            "Replacement_Level_Rusher", "Player_Model_ID_Rec", "Player_Model_ID_Rush"]
    qb = t.qb.select("Season", "Player_ID_Name", "Position", "Replacement_Level", "Player_Model_ID")
    return union_all([qb, *[x.select(*cols) for x in (t.rb, t.wr, t.te)]])


@query
def reuse_replacement(spark, sf):
    out = replacement.reuse_replacement_level(tables(spark, sf), _stored(pooled(spark, sf)))
    return _relabelled_counts(out)


# --- player effects ----------------------------------------------------------

@query
def passing_effects(spark, sf):
    t = pooled(spark, sf)
    return effects.passing_effects(t.passing)


@query
def rushing_effects(spark, sf):
    t = pooled(spark, sf)
    return effects.rushing_effects(t.rushing, effects.EP_MODELS)


@query
def oneway_effects(spark, sf):
    fits = oneway_fits(spark, sf).where(F.col("kind") == "effect")
    return rounded(fits.select("Season", "model", "factor", "level", "estimate"))


@query
def passing_effects_given(spark, sf):
    """Effects of the crossed passing models at given sd ratios."""
    return _given(spark, sf, "air", "yac")


@query
def rushing_effects_given(spark, sf):
    return _given(spark, sf, "qb_rush", "main_rush")


def _given(spark, sf, *models) -> DataFrame:
    fits = given_fits(spark, sf).where((F.col("kind") == "effect") & F.col("model").isin(*models))
    return rounded(fits.select("Season", "model", "factor", "level", "estimate"), digits=7)


@query
def value_added_given(spark, sf):
    out = value.add_value(pooled(spark, sf), given_fits(spark, sf))
    return rounded(season.all_positions(out, _value_columns("iPA", "iPAA")), digits=6)


@query
def value_added(spark, sf):
    out = value.add_value(pooled(spark, sf), season_fits(spark, sf))
    return season.all_positions(out, _value_columns("iPA", "iPAA"))


@query
def value_added_oneway(spark, sf):
    out = value.add_value(pooled(spark, sf), oneway_fits(spark, sf))
    return rounded(season.all_positions(out, _value_columns("iPA", "iPAA")))


def _bounds(t: SeasonTables) -> DataFrame:
    names = [f"{s}_{f}_{m}" for f in value.FACETS for s in ("Lower", "Upper") for m in ("iPA", "iPAA")]
    return season.all_positions(value.effect_intervals(t), ["Season", "Player_ID_Name", "Position", *names])


@query
def effect_intervals(spark, sf):
    return _bounds(value.add_value(pooled(spark, sf), season_fits(spark, sf)))


@query
def effect_intervals_oneway(spark, sf):
    return rounded(_bounds(value.add_value(pooled(spark, sf), oneway_fits(spark, sf))), digits=9)


@query
def effect_intervals_drawn(spark, sf):
    out = value.add_value(pooled(spark, sf), season_fits(spark, sf))
    out = value.effect_intervals(out, n_draws=200, seed=SEED)
    names = [f"Sim_{f}_iPA_SD" for f in value.FACETS]
    return season.all_positions(out, ["Season", "Player_ID_Name", "Position", *names])


# --- above replacement and wins ----------------------------------------------

def _value_columns(*measures: str, total: bool = False) -> list[str]:
    facets = [*value.FACETS, *(["total"] if total else [])]
    return ["Season", "Player_ID_Name", "Position",
            *[f"{f}_{m}" for m in measures for f in facets]]


@query
def above_replacement_given(spark, sf):
    """Value above replacement and wins from the crossed models at given sd ratios."""
    out = value.above_replacement(value.add_value(pooled(spark, sf), given_fits(spark, sf)))
    return rounded(season.all_positions(out, _value_columns("iPAR", total=True)), digits=6)


def _above(spark, sf) -> SeasonTables:
    return value.above_replacement(value.add_value(pooled(spark, sf), oneway_fits(spark, sf)))


@query
def above_replacement(spark, sf):
    return rounded(season.all_positions(_above(spark, sf), _value_columns("iPAR", total=True)))


@query
def prob_to_wins(spark, sf):
    out = value.prob_to_wins(_above(spark, sf))
    return rounded(season.all_positions(out, _value_columns("WAR", total=True)))


@query
def points_to_wins(spark, sf):
    price = standings.points_per_win(games_from_tables(spark, sf), ["Season"])
    out = value.points_to_wins(_above(spark, sf), price)
    return rounded(season.all_positions(out, _value_columns("WAR", total=True)))


@query
def points_per_win(spark, sf):
    games = games_from_tables(spark, sf)
    each = standings.points_per_win(games, ["Season"])
    pooled_price = standings.points_per_win(games).withColumn("Season", F.lit(None).cast("int"))
    return rounded(each.unionByName(pooled_price), digits=6)


@query
def season_war(spark, sf):
    cols = _value_columns("WAR", total=True)
    return season.all_positions(season_results(spark, sf), cols)


@query
def season_war_points(spark, sf):
    out = season.wins_from_points(model_plays(spark, sf), games_from_tables(spark, sf))
    return season.all_positions(out, _value_columns("WAR", total=True))


# --- bootstrap ---------------------------------------------------------------

@query
def resample_plays(spark, sf):
    keep = ["Season", "posteam", "sim_id", "GameID", "Drive", "PlayType"]
    used = dict.fromkeys([*[c for c in keep if c != "sim_id"], *PLAY_ORDER])
    out = boot.resample_plays(raw_plays(spark, sf).select(*used), SIMS, seed=SEED, order_by=PLAY_ORDER)
    return out.groupBy(*keep).agg(F.sum("copies").alias("copies"))


@query
def resample_drives(spark, sf):
    out = boot.resample_drives(model_plays(spark, sf), SIMS, seed=SEED)
    keep = ["Season", "posteam", "sim_id", "GameID", "Drive", "PlayType"]
    return out.groupBy(*keep).agg(F.sum("copies").alias("copies"))


@query
def bootstrap_splits(spark, sf):
    out = boot.bootstrap_splits(
        tables(spark, sf).passing, "passing", ["Season", "Passer_ID_Name"], SIMS, seed=SEED,
        units=boot.drive_units(model_plays(spark, sf)))
    return rounded(out, ["Passer_Rating"])


@query
def bootstrap_splits_receiving(spark, sf):
    out = boot.bootstrap_splits(
        tables(spark, sf).passing, "receiving", ["Season", "Receiver_ID_Name"], SIMS, seed=SEED,
        units=boot.drive_units(model_plays(spark, sf)))
    return out.select("Season", "Receiver_ID_Name", "sim_id", "Targets", "Receptions", "Rec_Drives")


@query
def bootstrap_splits_rushing(spark, sf):
    out = boot.bootstrap_splits(
        tables(spark, sf).rushing, "rushing", ["Season", "Rusher_ID_Name"], SIMS, seed=SEED,
        units=boot.drive_units(model_plays(spark, sf)))
    return out.select("Season", "Rusher_ID_Name", "sim_id", "Rushes", "Sacks", "Rush_Drives")


@query
def bootstrap_splits_season(spark, sf):
    """A split without the team: drive labels that several teams share count once."""
    out = boot.bootstrap_splits(
        tables(spark, sf).passing, "passing", ["Season"], SIMS, seed=SEED,
        units=boot.drive_units(model_plays(spark, sf)))
    return out.select("Season", "sim_id", "Pass_Attempts", "Pass_Drives")


def _drawn_tables(drawn: DataFrame, keys: tuple[str, ...], weight: str) -> SeasonTables:
    return season.season_tables(drawn, keys, weight)


@query
def bootstrap_pipeline(spark, sf):
    out = boot.simulate_seasons(model_plays(spark, sf), SIMS, _drawn_tables, seed=SEED, packed=True)
    cols = ["Season", "sim_id", "Player_ID_Name", "Position", "Rush_Attempts", "Total_Plays"]
    return season.all_positions(out, cols)


@query
def stack_results(spark, sf):
    """Replicates produced in batches, then stacked."""
    out = boot.simulate_seasons(
        model_plays(spark, sf), SIMS, _drawn_tables, seed=SEED, sims_per_batch=3, packed=True)
    return out.qb.select("sim_id", "Season", "Player_ID_Name", "Pass_Attempts", "Sacks")


@query
def bootstrap_war(spark, sf):
    out = season.bootstrap_wins(model_plays(spark, sf), _stored(season_results(spark, sf)), 3,
                                seed=SEED)
    return season.all_positions(out, ["sim_id", *_value_columns("WAR", total=True)])


# --- reliability -------------------------------------------------------------

METRICS = ["Comp_Perc", "Yards_per_Att", "Pass_EPA_per_Att", "Pass_Success_Rate"]


def _qb_stats(spark, sf) -> DataFrame:
    return splits.passing_splits(tables(spark, sf).passing, ["Season", "Passer_ID_Name"])


@query
def unpivot_stats(spark, sf):
    return reliability.unpivot_stats(_qb_stats(spark, sf), ["Season", "Passer_ID_Name"], METRICS)


@named("reliability")
def metric_reliability(spark, sf):
    drawn = boot.bootstrap_splits(
        tables(spark, sf).passing, "passing", ["Season", "Passer_ID_Name"], SIMS, seed=SEED,
        units=boot.drive_units(model_plays(spark, sf)))
    out = reliability.reliability(drawn, _qb_stats(spark, sf), "Passer_ID_Name", "Season",
                                  "Pass_Attempts", 10, METRICS)
    return rounded(out, digits=6)


@named("independence")
def metric_independence(spark, sf):
    return reliability.independence(_qb_stats(spark, sf), "Pass_Attempts", 10, METRICS)


@query
def cond_var(spark, sf):
    c = reliability.copula_correlation(_qb_stats(spark, sf), "Pass_Attempts", 10, METRICS)
    return reliability.cond_var(c, METRICS, METRICS[0], METRICS[1:])


@query
def independence_matrix(spark, sf):
    """Wide form, with two metrics that are equal by definition."""
    metrics = [*METRICS, "TD_per_Att", "Air_TD_per_Att"]
    long = reliability.independence(_qb_stats(spark, sf), "Pass_Attempts", 10, metrics)
    return reliability.independence_matrix(long, metrics)


@query
def independence_all(spark, sf):
    """All passing measures at once; many depend on others by definition."""
    stats = _qb_stats(spark, sf)
    metrics = [c for c in stats.columns if c not in ("Season", "Passer_ID_Name")]
    return reliability.independence(stats, "Pass_Attempts", 10, metrics)
