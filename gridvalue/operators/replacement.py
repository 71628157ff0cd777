"""Replacement-level players: four rules, relabelling of plays, reuse in replicates.

A rule maps :class:`SeasonTables` to the distinct (run keys, Player_ID_Name) at
replacement level. Depth rules are stated through their complement: the few
players above the cutoff are found by a trimmed top-k, everyone else is at
replacement level, so no task ever ranks a whole team or league.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import Tally, is_number, join_side, null_safe_join, settle, storage, top_rows, union_all
from .positions import qb_team_table
from .tables import PositionTables, SeasonTables

Rule = Callable[[SeasonTables], DataFrame]

# Roles of the replacement rules and the label each role's players get.
LABELS = {
    "QB": "Replacement_QB",
    "RB_rec": "Replacement_RB_rec",
    "WR_rec": "Replacement_WR_rec",
    "TE_rec": "Replacement_TE_rec",
    "RB_rush": "Replacement_RB_rush",
    "WR_TE_rush": "Replacement_WR_TE_rush",
}
# Which role wins when a player is in several, per facet of a play.
PRECEDENCE = {
    "Passer": ("QB",),
    "Receiver": ("RB_rec", "WR_rec", "TE_rec"),
    "Rusher": ("RB_rush", "WR_TE_rush", "QB"),
}
# Fixed values: (receiving role, rushing role) of each non-QB table.
TABLE_ROLES = {
    "RB": ("RB_rec", "RB_rush"), "WR": ("WR_rec", "WR_TE_rush"), "TE": ("TE_rec", "WR_TE_rush"),
}
LEAGUE_TEAMS = 32


def roster_replacement(depth: int, positions: Sequence[str] | str, play_type: str) -> Rule:
    """Players at team rank ``depth`` or deeper by attempts, on any of their teams.

    Equal attempts rank by name. Quarterbacks are ranked by passes whatever the
    ``play_type``; others by rushes (``"rush"``) or targets.
    """
    wanted = [positions] if isinstance(positions, str) else list(positions)

    def rule(tables: SeasonTables) -> DataFrame:
        if "QB" in wanted:
            plays, role = tables.passing, "Passer"
        elif play_type == "rush":
            plays, role = tables.rushing, "Rusher"
        else:
            plays, role = tables.passing, "Receiver"
        if role != "Passer":
            plays = plays.where(F.col(f"{role}_Position").isin(wanted))
        keys = list(tables.run_keys)
        counts = plays.groupBy(
            *keys, "posteam", F.col(f"{role}_ID_Name").alias("Player_ID_Name")
        ).agg(Tally(tables.weight).rows().alias("attempts"))
        if depth > 1:
            counts = settle(counts, "roster_counts")
            top = top_rows(counts, [*keys, "posteam"],
                           [F.desc("attempts"), F.asc("Player_ID_Name")], depth - 1, "rank")
            counts = null_safe_join(
                counts, top.select(*keys, "posteam", "Player_ID_Name"),
                [*keys, "posteam", "Player_ID_Name"], "left_anti",
            )
        return counts.select(*keys, "Player_ID_Name").distinct()

    return rule


def league_replacement(
    depth: int, position: str, attempts: str, combine_wrte: bool = False,
    strict_depth: bool = False, teams: int = LEAGUE_TEAMS,
) -> Rule:
    """Players after the first ``depth * teams`` of their table by ``attempts``.

    Equal attempts rank TE before WR, then players with passes or targets before
    players with rushes only, then by name. A table shorter than the cutoff
    yields its last player, unless ``strict_depth`` asks for none.
    """
    def rule(tables: SeasonTables) -> DataFrame:
        keys = list(tables.run_keys)
        named = tables.positions()
        if position == "QB":
            parts = [named["QB"]]
        elif position in ("RB", "FB"):
            parts = [named["RB"]]
        elif not combine_wrte and position in ("WR", "TE"):
            parts = [named[position]]
        else:
            parts = [named["TE"], named["WR"]]
        main = "Pass_Attempts" if position == "QB" else "Targets"
        ranked = union_all(
            p.select(*keys, "Player_ID_Name", F.lit(i).alias("part"),
                     F.col(attempts).alias("attempts"), (F.col(main) == 0).alias("side"))
            for i, p in enumerate(parts)
        )
        # One row past the cutoff tells whether the table is longer than it; the
        # last row of the trimmed table is never above replacement level.
        cutoff = depth * teams
        order = [F.desc("attempts"), F.asc("part"), F.asc("side"), F.asc("Player_ID_Name")]
        top = top_rows(ranked, keys, order, cutoff + 1, "rank")
        if strict_depth:
            top = top.where(F.col("rank") <= cutoff)
        else:
            top = top.withColumn("last", F.max("rank").over(Window.partitionBy(*keys)))
            top = top.where(F.col("rank") < F.col("last"))
        on = [*keys, "part", "Player_ID_Name"]
        return ranked.join(top.select(*on), on, "left_anti").select(
            *keys, "Player_ID_Name").distinct()

    return rule


def percentage_replacement_of(
    team_table: DataFrame, share: str, cutoff: float, run_keys: Sequence[str] = ("Season",)
) -> DataFrame:
    """Players whose share reaches ``cutoff`` on none of their teams."""
    reached = is_number(F.col(share)) & (F.col(share) >= cutoff)
    best = team_table.groupBy(*run_keys, "Player_ID_Name").agg(
        F.count_if(reached).alias("_reached")
    )
    return best.where(F.col("_reached") == 0).drop("_reached")


def percentage_replacement(share: str, cutoff: float) -> Rule:
    """Quarterbacks below a share of their team's attempts."""
    return lambda tables: percentage_replacement_of(
        qb_team_table(tables), share, cutoff, tables.run_keys
    )


def game_one_replacement() -> Rule:
    """Quarterbacks who never threw their team's first pass of its opening game.

    The opening game is the lowest game id with a first-quarter pass; the first
    pass has the most time remaining, ties going to the first name.
    """
    def rule(tables: SeasonTables) -> DataFrame:
        keys = list(tables.run_keys)
        passes = tables.passing.where(F.col("posteam").isNotNull())
        first = F.min(F.struct(
            F.col("GameID").isNull().alias("no_game"), "GameID",
            F.col("TimeSecs").isNull().alias("no_time"), (-F.col("TimeSecs")).alias("clock"),
            F.col("Passer_ID_Name").alias("Player_ID_Name"),
        )).alias("first")
        starters = passes.where(F.col("qtr") == 1).groupBy(*keys, "posteam").agg(first)
        starters = starters.select(*keys, "first.Player_ID_Name").distinct()
        everyone = passes.select(*keys, F.col("Passer_ID_Name").alias("Player_ID_Name")).distinct()
        return everyone.join(starters, [*keys, "Player_ID_Name"], "left_anti")

    return rule


# The replacement rules of the documented season pipeline.
DEFAULT_RULES: dict[str, Rule] = {
    "QB": percentage_replacement("Perc_Total_Plays", 0.1),
    "RB_rec": league_replacement(3, "RB", "Targets"),
    "WR_rec": league_replacement(4, "WR", "Targets"),
    "TE_rec": league_replacement(2, "TE", "Targets"),
    "RB_rush": league_replacement(3, "RB", "Rush_Attempts"),
    "WR_TE_rush": league_replacement(1, "WR", "Rush_Attempts", combine_wrte=True),
}


def replacement_sets(tables: SeasonTables, rules: Mapping[str, Rule]) -> DataFrame:
    """(run keys, role, Player_ID_Name) of all six roles."""
    missing = [r for r in LABELS if r not in rules]
    if missing:
        raise ValueError(f"no rule for {missing}")
    return union_all(
        rules[role](tables).withColumn("role", F.lit(role)) for role in LABELS
    )


def stored_sets(stored: PositionTables, keys: Sequence[str]) -> DataFrame:
    """The same sets, read back from the model ids of stored position tables."""
    def pick(table: DataFrame, column: str, role: str) -> DataFrame:
        return table.where(F.col(column) == LABELS[role]).select(
            *keys, "Player_ID_Name", F.lit(role).alias("role"))

    named = stored.positions()
    parts = [pick(named["QB"], "Player_Model_ID", "QB")]
    for position, (rec, rush) in TABLE_ROLES.items():
        parts.append(pick(named[position], "Player_Model_ID_Rec", rec))
        parts.append(pick(named[position], "Player_Model_ID_Rush", rush))
    return union_all(parts).distinct()


def _flags(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per replacement player with a boolean per role."""
    return sets.groupBy(*keys, "Player_ID_Name").agg(
        *[(F.count_if(F.col("role") == r) > 0).alias(f"_{r}") for r in LABELS]
    )


def _flagged(flags: DataFrame, keys: Sequence[str], roles: Sequence[str]) -> DataFrame:
    """The players at replacement level in one of the roles, with the flags of these."""
    named = [f"_{r}" for r in roles]
    return flags.where(reduce(or_, [F.col(n) for n in named])).select(*keys, "Player_ID_Name", *named)


def _relabelled(name: Column, roles: Sequence[str]) -> Column:
    out = None
    for r in roles:
        hit = F.col(f"_{r}")
        out = F.when(hit, LABELS[r]) if out is None else out.when(hit, LABELS[r])
    return out.otherwise(name)


def _relabel_by_position(frame: DataFrame, flags: DataFrame, keys: Sequence[str], role: str) -> DataFrame:
    """Relabel one role's players, of whom many are at replacement level, without
    shuffling the plays if few are not.

    Most players of a position get the label of that position (null: their own name). Only
    those who do not, by their exact flags, are joined to the plays.
    """
    name, position = f"{role}_ID_Name", f"{role}_Position"
    on = [*keys, name]
    players = frame.select(*on, position).distinct()
    known = players.join(_flagged(flags, keys, PRECEDENCE[role]).withColumnRenamed("Player_ID_Name", name), on, "left")
    label = _relabelled(F.lit(None).cast("string"), PRECEDENCE[role]).alias("_label")
    known = settle(known.select(*on, position, label), "role_labels")
    counts = known.groupBy(position, "_label").agg(F.struct(F.count(F.lit(1)), "_label").alias("_n"))
    usual = counts.groupBy(position).agg(F.max("_n")["_label"].alias("_usual"))
    usual = settle(usual, "usual_labels")
    unlike = null_safe_join(known, usual, [position], "inner").where(~F.col("_label").eqNullSafe(F.col("_usual")))
    unlike = settle(unlike.select(*on, position, "_label", F.lit(True).alias("_unlike")), "unlike_labels")
    out = null_safe_join(frame, usual, [position])
    out = null_safe_join(out, join_side(unlike), [*on, position])
    label = F.when(F.col("_unlike"), F.col("_label")).otherwise(F.col("_usual"))
    return out.withColumn(name, F.coalesce(label, F.col(name))).drop("_usual", "_label", "_unlike")


def _relabel(tables: SeasonTables, sets: DataFrame, keys: Sequence[str]) -> SeasonTables:
    flags = settle(_flags(sets, keys), "replacement")
    flag_cols = [f"_{r}" for r in LABELS]

    many = flags.count() > storage.BROADCAST_ROWS
    flags = flags.hint("merge") if many else flags

    def plays(frame: DataFrame, roles: Sequence[str]) -> DataFrame:
        for role in roles:
            if many and f"{role}_Position" in frame.columns:
                frame = _relabel_by_position(frame, flags, keys, role)
                continue
            name = f"{role}_ID_Name"
            named = _flagged(flags, keys, PRECEDENCE[role]).withColumnRenamed("Player_ID_Name", name)
            named = join_side(settle(named, "replacement_role")) if many else named
            frame = frame.join(named, [*keys, name], "left")
            frame = frame.withColumn(name, _relabelled(F.col(name), PRECEDENCE[role]))
            frame = frame.drop(*flag_cols)
        return frame

    def flagged(position: str, table: DataFrame) -> DataFrame:
        name = F.col("Player_ID_Name")
        roles = ("QB",) if position == "QB" else TABLE_ROLES[position]
        out = table.join(_flagged(flags, keys, roles), [*keys, "Player_ID_Name"], "left")

        def level(role: str) -> Column:
            return F.coalesce(F.col(f"_{role}").cast("int"), F.lit(0))

        def model_id(role: str) -> Column:
            return F.when(F.col(f"_{role}"), LABELS[role]).otherwise(name)

        if position == "QB":
            new = {"Replacement_Level": level("QB"), "Player_Model_ID": model_id("QB")}
        else:
            rec, rush = TABLE_ROLES[position]
            new = {
                "Replacement_Level_Receiver": level(rec), "Replacement_Level_Rusher": level(rush),
                "Player_Model_ID_Rec": model_id(rec), "Player_Model_ID_Rush": model_id(rush),
            }
        return out.withColumns(new).drop(*flag_cols)

    out = tables.map_positions(flagged)
    return replace(
        out,
        passing=plays(tables.passing, ("Passer", "Receiver")),
        rushing=plays(tables.rushing, ("Rusher",)),
    )


def find_replacement_level(
    tables: SeasonTables, rules: Mapping[str, Rule] = DEFAULT_RULES
) -> SeasonTables:
    """Pool replacement players under one label per role and flag the tables."""
    return _relabel(tables, replacement_sets(tables, rules), list(tables.run_keys))


def reuse_replacement_level(tables: SeasonTables, stored: PositionTables) -> SeasonTables:
    """The same, with the players of a stored run; all replicates share them."""
    keys = [k for k in tables.run_keys if k in stored.qb.columns]
    return _relabel(tables, stored_sets(stored, keys), keys)
