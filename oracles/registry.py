"""Oracle SQL per registered query."""

from __future__ import annotations

from . import duck
from .duck import compose, league_rule, pass_split, pos_team, roster_rule, rush_split, share_rule

_VALUE = '"Season", "Player_ID_Name", "Position"'
_FACETS = ("air", "yac", "rush")


def _tagged(rules: dict[str, str]) -> str:
    return " union all ".join(f"select *, '{n}' \"rule\" from ({s})" for n, s in rules.items())


def _round(names: list[str], digits: int = 10) -> str:
    return ", ".join(f'round("{n}" + 1e-{digits + 3}, {digits}) "{n}"' for n in names)


def _filled(select: str) -> str:
    """Missing and NaN become 0 in the statistics columns."""
    return f"""select * exclude ("Season", "Player_ID_Name", "Position"), {_VALUE} from (
 select {_VALUE}, coalesce(case when isnan(cast(columns(* exclude ("Season", "Player_ID_Name", "Position")) as double)) then 0
  else columns(* exclude ("Season", "Player_ID_Name", "Position")) end, 0) from ({select}))"""


def _skill_stats(pos: str) -> str:
    rec = pass_split("passes", '"Season", "Receiver_ID_Name"', "Rec")
    rush = rush_split("rushes", '"Season", "Rusher_ID_Name"')
    return _filled(f"""
select t.*, r.* exclude ("Season", "Receiver_ID_Name", "Targets", "Receptions"), r."Receptions" "Receptions_stat",
 u.* exclude ("Season", "Rusher_ID_Name", "Rushes", "Sacks") from {pos}_t t
left join ({rec}) r on r."Season" = t."Season" and r."Receiver_ID_Name" = t."Player_ID_Name"
left join ({rush}) u on u."Season" = t."Season" and u."Rusher_ID_Name" = t."Player_ID_Name" """)


_QB_STATS = f"""
select t.*, p.* exclude ("Season", "Passer_ID_Name", "Pass_Attempts"),
 u.* exclude ("Season", "Rusher_ID_Name", "Rushes", "Sacks"),
 (p."Pass_Yards_Gained" + 20 * p."Pass_TDs" - 45 * p."INTs" + u."Sack_Yards_Lost")
  / cast(t."Pass_Attempts" + t."Sacks" as double) "AdjNetYardsAtt" from QB_t t
left join ({pass_split("passes", '"Season", "Passer_ID_Name"', "Pass")}) p
 on p."Season" = t."Season" and p."Passer_ID_Name" = t."Player_ID_Name"
left join ({rush_split("rushes", '"Season", "Rusher_ID_Name"')}) u
 on u."Season" = t."Season" and u."Rusher_ID_Name" = t."Player_ID_Name" """

_RATING = '* replace (round("Passer_Rating" + 1e-13, 10) as "Passer_Rating")'
_QB_SPLIT = pass_split("passes", '"Season", "Passer_ID_Name"', "Pass")
_QB_BOOT = pass_split("sim_passes_rows", '"Season", "Passer_ID_Name", sim_id', "Pass")
_METRICS = ["Comp_Perc", "Yards_per_Att", "Pass_EPA_per_Att", "Pass_Success_Rate"]
_LONG = " union all ".join(
    f"select \"Season\", \"Passer_ID_Name\" \"Player\", '{m}' \"Metric\", \"{m}\" \"Value\" from {{0}} where \"Pass_Attempts\" >= 10"
    for m in _METRICS)


def _sim_counts() -> str:
    qb = f"""
select coalesce(p."Season", r."Season") "Season", coalesce(p.sim_id, r.sim_id) sim_id, coalesce(p.nm, r.nm) "Player_ID_Name",
 'QB' "Position", coalesce(pa, 0) "Pass_Attempts", coalesce(ra, 0) "Rush_Attempts", coalesce(sk, 0) "Sacks",
 coalesce(pa, 0) + coalesce(ra, 0) + coalesce(sk, 0) "Total_Plays"
from (select "Season", sim_id, "Passer_ID_Name" nm, count(*) pa from sim_passes_rows group by all) p
full join (select "Season", sim_id, "Rusher_ID_Name" nm, count(*) - cast(sum("Sack") as bigint) ra, cast(sum("Sack") as bigint) sk
 from sim_rushes_rows where "Rusher_Position" = 'QB' group by all) r
 on p."Season" = r."Season" and p.nm = r.nm and p.sim_id = r.sim_id"""
    parts = []
    for pos, wanted in (("RB", "('RB', 'FB')"), ("WR", "('WR')"), ("TE", "('TE')")):
        parts.append(f"""
select coalesce(p."Season", r."Season") "Season", coalesce(p.sim_id, r.sim_id) sim_id, coalesce(p.nm, r.nm) "Player_ID_Name",
 '{pos}' "Position", coalesce(ra, 0) "Rush_Attempts", coalesce(rc, 0) + coalesce(tg, 0) + coalesce(ra, 0) "Total_Plays"
from (select "Season", sim_id, "Receiver_ID_Name" nm, cast(sum("Reception") as bigint) rc, count(*) tg from sim_passes_rows
 where "Receiver_Position" in {wanted} group by all) p
full join (select "Season", sim_id, "Rusher_ID_Name" nm, count(*) ra from sim_rushes_rows
 where "Rusher_Position" in {wanted} group by all) r on p."Season" = r."Season" and p.nm = r.nm and p.sim_id = r.sim_id""")
    return qb, " union all ".join(parts)


_SIM_QB, _SIM_SKILL = _sim_counts()

_RELABELLED = """
select "Season", "Passer_ID_Name" "first", "Receiver_ID_Name" "second", count(*) n from pooled_passes group by all
union all select "Season", "Rusher_ID_Name", null, count(*) from pooled_rushes group by all"""

_FINAL: dict[str, str] = {
    "load_plays": "select * from plays",
    "load_rosters": "select * from rosters",
    "load_games": "select * from games",
    "write_read_season": " union all ".join(
        f'select {_VALUE}, "Total_Plays" from {p}_t' for p in ("QB", "RB", "WR", "TE")),
    "fix_team_code": """
select "Season", case when posteam = 'GERMANY' and "Season" = 1995 then 'GER' when posteam = 'FRANCE' and "Season" = 1997 then 'FRA' else posteam end posteam,
 case when "DefensiveTeam" = 'GERMANY' and "Season" = 1995 then 'GER' when "DefensiveTeam" = 'FRANCE' and "Season" = 1997 then 'FRA' else "DefensiveTeam" end "DefensiveTeam",
 count(*) n from plays group by all""",
    "common_name": " union all ".join(
        f"select \"Season\", id \"Player_ID\", nm \"Name\", '{r}' \"role\" from n_{r}" for r in ("Passer", "Receiver", "Rusher")),
    "id_name": 'select "Season", "Passer_ID_Name", "Receiver_ID_Name", "Rusher_ID_Name", count(*) n from named group by all',
    "sack_as_rush": 'select "Season", "PlayType", "Rusher_ID", "Rusher", "Rusher_Name", "Rusher_ID_Name", count(*) n from sacked group by all',
    "add_positions": """select "Season", "GameID", "Drive", "PlayType", "Passer_ID_Name", "Receiver_ID_Name", "Rusher_ID_Name",
 "Passer_Position", "Receiver_Position", "Rusher_Position" from placed""",
    "add_positions_by_season": """select "Season", case when "Receiver_Position" = 'WR' and "Season" % 2 = 0 then 'TE'
 else "Receiver_Position" end "Receiver_Position", count(*) plays from placed group by all""",
    "model_vars": """select "Season", "GameID", "Drive", "Shotgun_Ind", "No_Huddle_Ind", "Home_Ind", "airEPA_Result", "airWPA_Result",
 "yacEPA_Result", "yacWPA_Result", "RunGap", "Team_Side_Gap" from annot""",
    "pass_plays": 'select "Season", "GameID", "Drive", posteam, "Passer_ID_Name", "Receiver_ID_Name", "Receiver_Position", "EPA", "WPA" from passes',
    "rush_plays": 'select "Season", "GameID", "Drive", posteam, "Rusher_ID_Name", "Rusher_Position", "EPA", "WPA" from rushes',
    "team_rates": "select * from rates",
    "prepare_model_data": " union all ".join(f"""
select x."Season", "GameID", "Drive", x.posteam, "PlayType", "EPA", "Pass_EPA_Att", "Pass_WPA_Att", "Pass_Attempts",
 "Rush_EPA_Att", "Rush_WPA_Att", "Rush_Attempts" from {s} x left join rates r
 on r."Season" = x."Season" and r.posteam is not distinct from x.posteam""" for s in ("passes", "rushes")),
    "team_games": "select * from team_games",
    "season_summary": "select * from standings",
    "passing_splits": f"select {_RATING} from ({_QB_SPLIT})",
    "passing_splits_by_team_and_quarter":
        f"select {_RATING} from ({pass_split('passes', chr(34) + 'Season' + chr(34) + ', posteam, qtr', 'Pass')})",
    "receiving_splits": pass_split("passes", '"Season", "Receiver_ID_Name"', "Rec"),
    "rushing_splits": rush_split("rushes", '"Season", "Rusher_ID_Name"'),
    "game_drive": f'select "Season", posteam, {duck._DRIVES[:-3]} drives from passes group by "Season", posteam',
    "position_stats": f"select {_RATING} from ({_filled(_QB_STATS)})",
    "position_stats_receivers": " union all by name ".join(f"({_skill_stats(p)})" for p in ("RB", "WR", "TE")),
    "adj_net_yards": f'select "Season", "Player_ID_Name", "AdjNetYardsAtt" from ({_filled(_QB_STATS)})',
    "qb_table": "select * from QB_t",
    "rb_table": "select * from RB_t",
    "wr_table": "select * from WR_t",
    "te_table": "select * from TE_t",
    "add_position_tables": " union all ".join(
        f'select {_VALUE}, "Rush_Attempts", "Total_Plays" from {p}_t' for p in ("QB", "RB", "WR", "TE")),
    "qb_team_table": "select * from qb_team",
    "pos_team_table": " union all ".join(f"({pos_team(p)})" for p in ("RB", "WR", "TE")),
    "roster_replacement": _tagged({
        "QB": roster_rule(3, ("QB",), "pass"), "RB_rush": roster_rule(3, ("RB", "FB"), "rush"),
        "WR_rec": roster_rule(4, ("WR",), "pass")}),
    "league_replacement": _tagged({
        "QB": league_rule(1, "QB", "Pass_Attempts"), "RB": league_rule(3, "RB", "Rush_Attempts"),
        "WR": league_rule(4, "WR", "Targets"), "TE": league_rule(2, "TE", "Targets"),
        "WR_TE": league_rule(1, "WR", "Rush_Attempts", combine=True), "short": league_rule(500, "TE", "Targets")}),
    "pct_replacement": share_rule("Perc_Pass_Attempts", 0.2),
    "pct_replacement_fn": share_rule("Perc_Total_Plays", 0.1),
    "game_one_replacement": "select * from game_one",
    "apply_replacement": _RELABELLED,
    "reuse_replacement": _RELABELLED,
    "apply_replacement_tables": 'select "Season", "Player_ID_Name", "Position", "Replacement_Level", "Player_Model_ID" from QB_f'
        + "".join(f""" union all by name select {_VALUE}, "Replacement_Level_Receiver", "Replacement_Level_Rusher",
 "Player_Model_ID_Rec", "Player_Model_ID_Rush" from {p}_f""" for p in ("RB", "WR", "TE")),
    "oneway_effects": " union all ".join(
        f"select \"Season\", '{m}' \"model\", '{f}' \"factor\", lv \"level\", round(est + 1e-13, 10) \"estimate\" from u_{u}"
        for u, m, f in (("air_P", "air", "Passer_ID_Name"), ("yac_P", "yac", "Passer_ID_Name"),
                        ("air_R", "air", "Receiver_ID_Name"), ("yac_R", "yac", "Receiver_ID_Name"),
                        ("rush_P", "qb_rush", "Rusher_ID_Name"), ("rush_R", "main_rush", "Rusher_ID_Name"))),
    **{f"{kind}_effects_given": 'select "Season", model, factor, lv "level", round(est + 1e-10, 7) "estimate" from mme_fit '
        f"where model in ({models})" for kind, models in (("passing", "'air', 'yac'"), ("rushing", "'qb_rush', 'main_rush'"))},
    "value_added_given": f"select {_VALUE}, {_round([f'{f}_{m}' for m in ('iPA', 'iPAA') for f in _FACETS], 6)} from valued_given",
    "above_replacement_given": f"select {_VALUE}, {_round([f'{f}_iPAR' for f in (*_FACETS, 'total')], 6)} from above_given",
    "value_added_oneway": f"select {_VALUE}, {_round([f'{f}_{m}' for m in ('iPA', 'iPAA') for f in _FACETS])} from valued",
    "effect_intervals_oneway": f"select {_VALUE}, " + ", ".join(
        f'round({n} ("{f}_iPA" {sign} 2 * {f}_sd) + 1e-12, 9) "{side}_{f}_{m}"'
        for f in _FACETS for side, sign in (("Lower", "-"), ("Upper", "+"))
        for m, n in (("iPA", ""), ("iPAA", f"n_{'rush' if f == 'rush' else 'air'} *"))) + " from valued",
    "above_replacement": f"select {_VALUE}, {_round([f'{f}_iPAR' for f in (*_FACETS, 'total')])} from above",
    "prob_to_wins": f"select {_VALUE}, " + ", ".join(f'round("{f}_iPAR" + 1e-13, 10) "{f}_WAR"' for f in (*_FACETS, "total")) + " from above",
    "points_to_wins": 'select x."Season", "Player_ID_Name", "Position", '
        + ", ".join(f'round("{f}_iPAR" / price + 1e-13, 10) "{f}_WAR"' for f in (*_FACETS, "total"))
        + ' from above x join ppw p on p."Season" = x."Season"',
    "points_per_win": """select "Season", round(price + 1e-9, 6) points_per_win from ppw
 union all select null, round(1 / regr_slope("Wins", "Total_Score_Diff") + 1e-9, 6) from standings""",
    "resample_plays": """select "Season", posteam, sim_id, "GameID", "Drive", "PlayType", cast(sum(copies) as bigint) copies
 from play_units join play_draws using ("Season", posteam, u) group by all""",
    "resample_drives": """select p."Season", p.posteam, sim_id, "GameID", "Drive", "PlayType", cast(sum(copies) as bigint) copies
 from annot p join drive_copies d on d."Season" = p."Season" and d.posteam = p.posteam
 and gd = coalesce(cast("GameID" as varchar), 'NA') || '-' || coalesce(cast("Drive" as varchar), 'NA') group by all""",
    "bootstrap_splits": f"select {_RATING} from ({_QB_BOOT})",
    "bootstrap_splits_receiving": """select "Season", "Receiver_ID_Name", sim_id, "Targets", "Receptions", "Rec_Drives" from ("""
        + pass_split("sim_passes_rows", '"Season", "Receiver_ID_Name", sim_id', "Rec") + ")",
    "bootstrap_splits_rushing": """select "Season", "Rusher_ID_Name", sim_id, "Rushes", "Sacks", "Rush_Drives" from ("""
        + rush_split("sim_rushes_rows", '"Season", "Rusher_ID_Name", sim_id') + ")",
    "bootstrap_splits_season": """select "Season", sim_id, "Pass_Attempts", "Pass_Drives" from ("""
        + pass_split("sim_passes_rows", '"Season", sim_id', "Pass") + ")",
    "bootstrap_pipeline": f'select "Season", sim_id, "Player_ID_Name", "Position", "Rush_Attempts", "Total_Plays" from ({_SIM_QB}) union all {_SIM_SKILL}',
    "stack_results": f'select sim_id, "Season", "Player_ID_Name", "Pass_Attempts", "Sacks" from ({_SIM_QB})',
    "unpivot_stats": " union all ".join(
        f"select \"Season\", \"Passer_ID_Name\", '{m}' \"Metric\", \"{m}\" \"Value\" from ({_QB_SPLIT})" for m in _METRICS),
    "reliability": f"""
select d."Metric", round(d.v + 1e-9, 6) "Discrimination", round(s.v + 1e-9, 6) "Stability" from (
 select "Metric", case when count(x) = count(*) then avg(x) end v from (
  select "Season", "Metric", 1 - avg(bv) / var_samp("Value") x from joined_metrics group by all) group by all) d
join (select "Metric", 1 - avg(pv - bv) / (max(tv) - avg(bv)) v from joined_metrics group by all) s using ("Metric")""",
}

duck.CTES["metric_stats"] = _QB_SPLIT
duck.CTES["metric_boots"] = _QB_BOOT
duck.CTES["long_stats"] = _LONG.format("metric_stats")
duck.CTES["long_boots"] = _LONG.format("metric_boots")
duck.CTES["joined_metrics"] = """
select v.*, pv, tv, bv from long_stats v
left join (select "Player", "Metric", var_samp("Value") pv from long_stats group by all) p using ("Player", "Metric")
left join (select "Metric", var_samp("Value") tv from long_stats group by all) t using ("Metric")
left join (select "Season", "Player", "Metric", var_samp("Value") bv from long_boots group by all) b using ("Season", "Player", "Metric")
"""


def oracle_sql() -> dict[str, str]:
    return {name: compose(sql) for name, sql in _FINAL.items()}
