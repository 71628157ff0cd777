"""From raw plays to modelling plays: identities, covariates, filters, team rates."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    Tally, attach, ieee_div, if_known, join_side, label, null_safe_join, settle, settle_parts, text_flag,
    union_all,
)
from .tables import SeasonTables

# Fixed values: (team code, season, code used from then on).
TEAM_RENAMES = (("JAC", 2016, "JAX"),)
NOBODY = "None"
ROLES = ("Passer", "Receiver", "Rusher")


def fix_team_code(
    df: DataFrame,
    columns: Sequence[str] = ("posteam", "DefensiveTeam"),
    renames: Iterable[tuple[str, int, str]] = TEAM_RENAMES,
) -> DataFrame:
    """Replace a team code in the seasons where the feed used an old one."""
    out = {}
    for name in columns:
        c = F.col(name)
        for old, season, new in renames:
            c = F.when((c == old) & (F.col("Season") == season), new).otherwise(c)
        out[name] = c
    return df.withColumns(out)


def common_name(
    plays: DataFrame, id_col: str, name_col: str, out: str = "Name",
    run_keys: Sequence[str] = ("Season",),
) -> DataFrame:
    """Most frequent spelling per player id; ties go to the first in byte order.

    Counting (id, name) pairs first keeps the state of a player with many plays
    or many spellings out of any single aggregation buffer.
    """
    keys = [*run_keys, id_col]
    pairs = plays.groupBy(*keys, F.col(name_col).alias("_name")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    best = F.min(F.when(
        F.col("_name").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_name").alias("v"))
    ))
    return pairs.groupBy(*keys).agg(F.coalesce(best["v"], F.lit(NOBODY)).alias(out))


def name_tables(plays: DataFrame, run_keys: Sequence[str] = ("Season",)) -> dict[str, DataFrame]:
    """Common names of all three roles as written tables (run keys, Player_ID, Name)."""
    parts = {
        role: common_name(plays, f"{role}_ID", role, "Name", run_keys)
        .withColumnRenamed(f"{role}_ID", "Player_ID")
        for role in ROLES
    }
    return settle_parts(parts, "names")


def id_name(
    plays: DataFrame, run_keys: Sequence[str] = ("Season",),
    names: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Attach ``{role}_Name`` and the ``Name-ID`` label of passer, receiver, rusher, and
    the further columns of ``names``, by default those of :func:`name_tables`."""
    names = names or name_tables(plays, run_keys)
    columns = list(plays.columns)
    columns += [f"{r}_{c}" for r in ROLES for c in names[r].columns if c not in (*run_keys, "Player_ID")]
    # Passers are the fewest, so they come last: what they add need not be shuffled.
    for role in reversed(ROLES):
        on = {**{k: k for k in run_keys}, f"{role}_ID": "Player_ID"}
        new = {c: f"{role}_{c}" for c in names[role].columns if c not in on.values()}
        plays = attach(plays, names[role].withColumnsRenamed(new), on)
    return plays.select(*dict.fromkeys(columns)).withColumns(
        {f"{r}_ID_Name": label(f"{r}_Name", f"{r}_ID") for r in ROLES}
    )


def sack_as_rush(plays: DataFrame) -> DataFrame:
    """Make the passer the rusher on sacks; an unknown play type has no rusher."""
    sack = F.col("PlayType") == "Sack"
    swaps = {f"Rusher{s}": f"Passer{s}" for s in ("_ID", "_Name", "", "_ID_Name")}
    return plays.withColumns(
        {r: if_known(sack, F.col(p), F.col(r)) for r, p in swaps.items() if r in plays.columns}
    )


def roster_positions(
    plays: DataFrame, rosters: DataFrame, run_keys: Sequence[str] = ("Season",),
    on_multi_position: str = "fanout",
) -> DataFrame:
    """Attach the roster position of each role.

    A player listed at several positions repeats the play once per position
    (``"fanout"``) or keeps the first position in byte order (``"first"``). Rosters
    without a run key that the plays have, such as the season, hold for all its values;
    a warning says so, since a player who changed position then fans out everywhere.
    """
    keys, listed = _listed(plays, rosters, run_keys, on_multi_position)
    listed = join_side(settle(listed, "rosters"))
    for role in ROLES:
        on = {**{k: k for k in keys}, f"{role}_ID": "GSIS_ID"}
        plays = null_safe_join(plays, listed.withColumnRenamed("Pos", f"{role}_Position"), on)
    return plays


def _listed(
    plays: DataFrame, rosters: DataFrame, run_keys: Sequence[str], on_multi_position: str
) -> tuple[list[str], DataFrame]:
    """The run keys of the rosters, and their distinct (run keys, GSIS_ID, Pos)."""
    keys = [k for k in run_keys if k in rosters.columns]
    if pooled := [k for k in run_keys if k in plays.columns and k not in keys]:
        warnings.warn(f"rosters hold for every {', '.join(pooled)}", stacklevel=3)
    listed = rosters.select(*keys, "GSIS_ID", "Pos").distinct()
    if on_multi_position == "first":
        listed = listed.groupBy(*keys, "GSIS_ID").agg(F.min("Pos").alias("Pos"))
    elif on_multi_position != "fanout":
        raise ValueError(f"on_multi_position: {on_multi_position!r}")
    return keys, listed


def _listed_names(
    names: dict[str, DataFrame], keys: Sequence[str], listed: DataFrame, run_keys: Sequence[str]
) -> dict[str, DataFrame]:
    """Name tables with a row for each position of the player; rushers include whoever
    becomes one on a sack, and the missing player of an unknown play type."""
    by = [*run_keys, "Player_ID"]
    passers = names["Passer"].select(*by)
    nobody = passers.withColumn("Player_ID", F.lit(None).cast("string"))
    more = passers.unionByName(nobody).withColumn("Name", F.lit(None).cast("string"))
    rushers = names["Rusher"].unionByName(more).groupBy(*by).agg(F.max("Name").alias("Name"))
    on = {**{k: k for k in keys}, "Player_ID": "GSIS_ID"}
    tables = {**names, "Rusher": rushers}
    return settle_parts({
        r: null_safe_join(t, listed.withColumnRenamed("Pos", "Position"), on) for r, t in tables.items()
    }, "players")


def add_positions(
    plays: DataFrame, rosters: DataFrame, run_keys: Sequence[str] = ("Season",),
    on_multi_position: str = "fanout",
) -> DataFrame:
    """Team codes, identities, sacks as rushes and roster positions.

    Names and positions are joined to each other first, so plays are joined once a role.
    """
    plays = fix_team_code(plays)
    keys, listed = _listed(plays, rosters, run_keys, on_multi_position)
    listed = join_side(settle(listed, "rosters"))
    players = _listed_names(name_tables(plays, run_keys), keys, listed, run_keys)
    sack = F.col("PlayType") == "Sack"
    plays = plays.withColumn("Rusher_ID", if_known(sack, F.col("Passer_ID"), F.col("Rusher_ID")))
    plays = sack_as_rush(id_name(plays, run_keys, players))
    positions = [f"{r}_Position" for r in ROLES]
    rest = plays.drop(*[f"{r}_Name" for r in ROLES], *positions)
    return plays.select(*rest.columns, *positions)


def add_situation(plays: DataFrame) -> DataFrame:
    """Flags of the situation, read from texts."""
    return plays.withColumns({
        "Shotgun_Ind": text_flag("desc", "Shotgun"),
        "No_Huddle_Ind": text_flag("desc", "No Huddle"),
        "Home_Ind": if_known(F.col("posteam") == F.col("HomeTeam"), F.lit(1), F.lit(0)),
    })


def add_results(plays: DataFrame) -> DataFrame:
    """Per-component results and the team-side-gap label."""
    caught = F.col("Reception") == 1
    results = {
        f"{part}{m}_Result": if_known(caught, F.col(f"{part}{m}"), F.col(m))
        for m in ("EPA", "WPA") for part in ("air", "yac")
    }
    gap = if_known(F.col("RunLocation") == "middle", F.lit("center"), F.col("RunGap"))
    flagged = plays.withColumns({**results, "RunGap": gap})
    return flagged.withColumn("Team_Side_Gap", label("posteam", "RunLocation", "RunGap"))


def add_model_variables(plays: DataFrame) -> DataFrame:
    """Situation flags, per-component results and the team-side-gap label."""
    return add_results(add_situation(plays))


def is_pass() -> Column:
    """Passing plays used for modelling."""
    needed = ["airEPA_Result", "airWPA_Result", "yacEPA_Result", "yacWPA_Result",
              "PassLocation", "Receiver_Position", "Passer_Position"]
    cond = F.col("PlayType") == "Pass"
    for c in needed:
        cond &= F.col(c).isNotNull()
    cond &= (F.col("Receiver_ID") != NOBODY) & (F.col("Passer_ID") != NOBODY)
    return cond & (F.col("Passer_Position") == "QB") & (F.col("Receiver_Position") != "QB")


def is_rush() -> Column:
    """Rushing plays and sacks used for modelling."""
    cond = F.col("PlayType").isin("Run", "Sack")
    for c in ("EPA", "WPA", "Rusher_Position"):
        cond &= F.col(c).isNotNull()
    return cond & (F.col("Rusher_ID") != NOBODY)


def pass_plays(plays: DataFrame) -> DataFrame:
    return plays.where(is_pass())


def rush_plays(plays: DataFrame) -> DataFrame:
    return plays.where(is_rush())


def team_rates(
    passing: DataFrame, rushing: DataFrame, run_keys: Sequence[str] = ("Season",),
    weight: str | None = None,
) -> DataFrame:
    """Passing and rushing EPA, WPA and attempts per team, in one aggregation.

    A team without plays of one kind has missing values for that kind.
    """
    t = Tally(weight)
    keep = [*run_keys, "posteam", "EPA", "WPA", *([weight] if weight else [])]
    rows = union_all(
        f.select(*keep, F.lit(kind).alias("kind"))
        for kind, f in (("Pass", passing), ("Rush", rushing))
    )
    kinds = {k: F.col("kind") == k for k in ("Pass", "Rush")}
    sums = []
    for kind, cond in kinds.items():
        sums.append(t.rows_where(cond).alias(f"{kind}_Attempts"))
        sums += [t.total(F.when(cond, F.col(m))).alias(f"{kind}_{m}") for m in ("EPA", "WPA")]
    out = rows.groupBy(*run_keys, "posteam").agg(*sums)
    cols = {}
    for kind in kinds:
        n = F.col(f"{kind}_Attempts")
        for m in ("EPA", "WPA"):
            cols[f"{kind}_{m}"] = F.when(n > 0, F.col(f"{kind}_{m}"))
            cols[f"{kind}_{m}_Att"] = F.when(n > 0, ieee_div(F.col(f"{kind}_{m}"), n))
        cols[f"{kind}_Attempts"] = F.when(n > 0, n)
    order = [f"{k}_{x}" for k in kinds for x in ("EPA", "WPA", "Attempts", "EPA_Att", "WPA_Att")]
    return out.select(*run_keys, "posteam", *[cols[c].alias(c) for c in order])


def with_team_rates(
    passing: DataFrame, rushing: DataFrame, run_keys: Sequence[str] = ("Season",),
    weight: str | None = None,
) -> SeasonTables:
    """Modelling plays, each with the rates of the team in possession."""
    rates = settle(team_rates(passing, rushing, run_keys, weight), "team_rates")
    keys = [*run_keys, "posteam"]
    return SeasonTables(
        passing=null_safe_join(passing, rates, keys),
        rushing=null_safe_join(rushing, rates, keys),
        run_keys=tuple(run_keys),
        weight=weight,
    )


def prepare_model_data(
    plays: DataFrame, run_keys: Sequence[str] = ("Season",), weight: str | None = None
) -> SeasonTables:
    """Passing and rushing plays with team rates, from plays with model variables."""
    return with_team_rates(pass_plays(plays), rush_plays(plays), run_keys, weight)
