"""DuckDB SQL that recomputes every relational query from the driver tables.

Each query is a chain of named common table expressions; ``compose`` keeps only
those a query needs. The SQL is written apart from the Spark library.
"""

from __future__ import annotations

import re

from . import crossed

SEED = 7

CTES: dict[str, str] = {}

CTES["plays"] = """
with b as (
 select l.l_orderkey, l.l_partkey, l.l_linenumber, l.l_returnflag, l.l_linestatus,
  cast(l.l_quantity as int) q, cast(round(l.l_discount*100) as int) d, cast(round(l.l_tax*100) as int) t,
  cast(year(o.o_orderdate) as int) season, s.s_nationkey snk, ns.n_name pt, nc.n_name dt,
  case when l.l_returnflag='R' or (l.l_returnflag='A' and l.l_linestatus='O') then 'Pass'
       when l.l_returnflag='N' then 'Run' else 'Sack' end pty,
  case when cast(l.l_quantity as int)<=30 then 0 when cast(l.l_quantity as int)<=44 then 1 when cast(l.l_quantity as int)<=48 then 2 else 3 end qi,
  case when l.l_linestatus='O' then 1 else 0 end rc
 from lineitem l join orders o on l.l_orderkey=o.o_orderkey join supplier s on l.l_suppkey=s.s_suppkey
 join nation ns on s.s_nationkey=ns.n_nationkey join customer c on o.o_custkey=c.c_custkey join nation nc on c.c_nationkey=nc.n_nationkey)
select season "Season", l_orderkey "GameID", l_linenumber "Drive", 1 + l_linenumber % 4 qtr,
 cast(3600 - 60*l_linenumber - q as double) "TimeSecs",
 case when q=50 and l_linenumber=7 then null else pt end posteam, dt "DefensiveTeam",
 case when l_orderkey % 2 = 0 then pt else dt end "HomeTeam",
 case when q=13 then null when l_linenumber % 3 = 0 then '(Shotgun) play' when l_linenumber % 3 = 1 then '(No Huddle, Shotgun) play' else 'play' end "desc",
 pty "PlayType",
 case when pty='Run' then 'None' else concat('Q-', cast(snk*10+qi as varchar(20))) end "Passer_ID",
 case when pty='Run' or q=17 then null when q % 10 = 0 then concat('q.', cast(snk*10+qi as varchar(20))) else concat('Q.', cast(snk*10+qi as varchar(20))) end "Passer",
 case when pty='Pass' then concat('P-', cast(l_partkey as varchar(20))) else 'None' end "Receiver_ID",
 case when pty='Pass' then concat('P.', cast(l_partkey as varchar(20))) end "Receiver",
 case when pty<>'Run' then 'None' when q % 9 = 0 then concat('Q-', cast(snk*10+qi as varchar(20))) else concat('P-', cast(l_partkey as varchar(20))) end "Rusher_ID",
 case when pty<>'Run' then null when q % 9 = 0 then concat('Q.', cast(snk*10+qi as varchar(20))) else concat('P.', cast(l_partkey as varchar(20))) end "Rusher",
 case when pty<>'Pass' or q=37 then null when l_partkey % 3 = 0 then 'left' when l_partkey % 3 = 1 then 'middle' else 'right' end "PassLocation",
 case when pty<>'Run' then null when q % 3 = 0 then 'left' when q % 3 = 1 then 'middle' else 'right' end "RunLocation",
 case when pty<>'Run' or q % 3 = 1 then null when l_linenumber % 3 = 0 then 'end' when l_linenumber % 3 = 1 then 'guard' else 'tackle' end "RunGap",
 case when pty='Pass' then rc else 0 end "Reception",
 case when pty='Pass' then cast(q-10 as double) end "AirYards",
 case when pty='Pass' then cast(rc*t as double) end "YardsAfterCatch",
 cast(case pty when 'Pass' then rc*(q-10+t) when 'Run' then q % 12 - 2 else -(q % 9) end as double) "Yards_Gained",
 case when pty<>'Run' and q % 7 = 0 then 1 else 0 end "QBHit",
 case when pty='Pass' and rc=0 and q % 11 = 0 then 1 else 0 end "InterceptionThrown",
 case when (pty='Pass' and rc=1 and q>=47) or (pty='Run' and q>=48) then 1 else 0 end "Touchdown",
 case when pty='Sack' then 1 else 0 end "Sack",
 case when pty<>'Pass' and q % 23 = 0 then 1 else 0 end "Fumble",
 case when q=41 and l_linenumber=6 then null else cast((d-5)*8+q-25 as double)/64 end "EPA",
 case when q=41 and l_linenumber=6 then null else cast((d-5)*8+q-25 as double)/4096 end "WPA",
 case when pty='Pass' then cast((d-5)*8 as double)/64 end "airEPA",
 case when pty='Pass' then cast((d-5)*8 as double)/4096 end "airWPA",
 case when pty='Pass' then cast(q-25 as double)/64 end "yacEPA",
 case when pty='Pass' then cast(q-25 as double)/4096 end "yacWPA"
from b
"""
CTES["rosters"] = """
select distinct * from (
select concat('P-', cast(p_partkey as varchar(20))) "GSIS_ID",
 case p_type when 'MEDIUM' then 'WR' when 'STANDARD' then 'WR' when 'LARGE' then 'TE' when 'PROMO' then 'RB' else 'FB' end "Pos"
from part where p_type <> 'ECONOMY'
union all
select concat('Q-', cast(n_nationkey*10+i as varchar(20))), 'QB' from nation cross join (select 0 i union all select 1 union all select 2 union all select 3) x)
"""
CTES["games"] = """
select o_orderkey "GameID", cast(year(o_orderdate) as int) "Season", nc.n_name home, ns.n_name away,
 cast(o_orderkey % 35 as int) homescore, cast((o_custkey*7) % 31 as int) awayscore
from orders join customer on o_custkey=c_custkey join nation nc on c_nationkey=nc.n_nationkey
join nation ns on ns.n_nationkey=(c_nationkey+1+o_orderkey % 24) % 25
"""

for role in ("Passer", "Receiver", "Rusher"):
    CTES[f"n_{role}"] = f"""
select "Season", id, coalesce(max(case when k = 1 then nm end), 'None') nm from (
 select "Season", id, nm, row_number() over (partition by "Season", id, nm is null order by n desc, nm) k_raw,
  case when nm is null then null else row_number() over (partition by "Season", id, nm is null order by n desc, nm) end k
 from (select "Season", "{role}_ID" id, "{role}" nm, count(*) n from plays group by all))
group by "Season", id
"""

CTES["named"] = """
select p.*, a.nm "Passer_Name", b.nm "Receiver_Name", c.nm "Rusher_Name",
 a.nm || '-' || coalesce("Passer_ID", 'NA') "Passer_ID_Name",
 b.nm || '-' || coalesce("Receiver_ID", 'NA') "Receiver_ID_Name",
 c.nm || '-' || coalesce("Rusher_ID", 'NA') "Rusher_ID_Name"
from plays p
left join n_Passer a on a."Season" = p."Season" and a.id is not distinct from p."Passer_ID"
left join n_Receiver b on b."Season" = p."Season" and b.id is not distinct from p."Receiver_ID"
left join n_Rusher c on c."Season" = p."Season" and c.id is not distinct from p."Rusher_ID"
"""
CTES["sacked"] = """
select * replace (
 case when "PlayType" = 'Sack' then "Passer_ID" when "PlayType" <> 'Sack' then "Rusher_ID" end as "Rusher_ID",
 case when "PlayType" = 'Sack' then "Passer_Name" when "PlayType" <> 'Sack' then "Rusher_Name" end as "Rusher_Name",
 case when "PlayType" = 'Sack' then "Passer" when "PlayType" <> 'Sack' then "Rusher" end as "Rusher",
 case when "PlayType" = 'Sack' then "Passer_ID_Name" when "PlayType" <> 'Sack' then "Rusher_ID_Name" end as "Rusher_ID_Name")
from named
"""
CTES["placed"] = """
select s.*, a."Pos" "Passer_Position", b."Pos" "Receiver_Position", c."Pos" "Rusher_Position"
from sacked s left join rosters a on a."GSIS_ID" = s."Passer_ID"
left join rosters b on b."GSIS_ID" = s."Receiver_ID" left join rosters c on c."GSIS_ID" = s."Rusher_ID"
"""
CTES["annot"] = """
select *, coalesce(posteam, 'NA') || '-' || coalesce("RunLocation", 'NA') || '-' || coalesce("RunGap", 'NA') "Team_Side_Gap"
from (select * replace (case when "RunLocation" = 'middle' then 'center' when "RunLocation" <> 'middle' then "RunGap" end as "RunGap"),
 case when contains("desc", 'Shotgun') then 1 else 0 end "Shotgun_Ind",
 case when contains("desc", 'No Huddle') then 1 else 0 end "No_Huddle_Ind",
 case when posteam = "HomeTeam" then 1 when posteam <> "HomeTeam" then 0 end "Home_Ind",
 case when "Reception" = 1 then "airEPA" when "Reception" <> 1 then "EPA" end "airEPA_Result",
 case when "Reception" = 1 then "airWPA" when "Reception" <> 1 then "WPA" end "airWPA_Result",
 case when "Reception" = 1 then "yacEPA" when "Reception" <> 1 then "EPA" end "yacEPA_Result",
 case when "Reception" = 1 then "yacWPA" when "Reception" <> 1 then "WPA" end "yacWPA_Result"
 from placed)
"""
CTES["passes"] = """
select * from annot where "PlayType" = 'Pass' and "airEPA_Result" is not null and "airWPA_Result" is not null
 and "yacEPA_Result" is not null and "yacWPA_Result" is not null and "PassLocation" is not null
 and "Receiver_Position" is not null and "Passer_Position" is not null
 and "Receiver_ID" <> 'None' and "Passer_ID" <> 'None' and "Passer_Position" = 'QB' and "Receiver_Position" <> 'QB'
"""
CTES["rushes"] = """
select * from annot where "PlayType" in ('Run', 'Sack') and "EPA" is not null and "WPA" is not null
 and "Rusher_Position" is not null and "Rusher_ID" <> 'None'
"""
for kind, src in (("Pass", "passes"), ("Rush", "rushes")):
    CTES[f"rates_{kind}"] = f"""
select "Season", posteam, coalesce(sum("EPA"), 0) "{kind}_EPA", coalesce(sum("WPA"), 0) "{kind}_WPA",
 count(*) "{kind}_Attempts", coalesce(sum("EPA"), 0) / count(*) "{kind}_EPA_Att",
 coalesce(sum("WPA"), 0) / count(*) "{kind}_WPA_Att" from {src} group by all
"""
CTES["rates"] = """
select coalesce(p."Season", r."Season") "Season", coalesce(p.posteam, r.posteam) posteam,
 p.* exclude ("Season", posteam), r.* exclude ("Season", posteam)
from rates_Pass p full join rates_Rush r on p."Season" = r."Season" and p.posteam is not distinct from r.posteam
"""

CTES["team_games"] = """
select g."GameID", g."Season", w "Winner", loc "Team_Loc", team "Team", diff "Score_Diff",
 case when team = w then 1 when team <> w then 0 end "Win_Ind" from (
 select *, case when homescore > awayscore then home when homescore < awayscore then away
  when homescore = awayscore then 'TIE' end w from games) g,
 lateral (select 'home' loc, home team, homescore - awayscore diff union all select 'away', away, awayscore - homescore) x
"""
CTES["standings"] = """
select "Season", "Team", cast(case when count("Win_Ind") = count(*) then sum("Win_Ind") end as bigint) "Wins",
 cast(case when count("Score_Diff") = count(*) then sum("Score_Diff") end as bigint) "Total_Score_Diff"
from team_games group by all
"""


def _div(a: str, b: str) -> str:
    return f"(cast({a} as double) / cast({b} as double))"


def _totals(pairs: dict[str, str]) -> str:
    out = []
    for name, x in pairs.items():
        if x.startswith("#"):  # number of rows
            out.append(f"count(*) filter (where {x[1:]}) {name}")
        elif x.startswith("@"):  # whole-number sum
            out.append(f"cast(coalesce(sum({x[1:]}), 0) as bigint) {name}")
        else:
            out.append(f"coalesce(sum({x}), 0) {name}")
    return ", ".join(out)


_PASS_TOTALS = {
    "c": '@"Reception"', "y": '"Yards_Gained"', "ay": '"AirYards"', "ayc": '"Reception" * "AirYards"',
    "yac": '"Reception" * "YardsAfterCatch"', "hit": '@"QBHit"', "pick": '@"InterceptionThrown"',
    "td": '@"Touchdown"', "atd": '@case when "YardsAfterCatch" = 0 then "Touchdown" when "YardsAfterCatch" <> 0 then 0 end',
    "clutch": '"EPA" * abs("WPA")',
    "e": '"EPA"', "eup": '#"EPA" > 0', "ec": '"Reception" * "EPA"', "eabs": 'abs("EPA")',
    "w": '"WPA"', "wup": '#"WPA" > 0', "wc": '"Reception" * "WPA"', "wabs": 'abs("WPA")',
    "ae": '"Reception" * "airEPA"', "aeup": '#"airEPA" > 0', "aecup": '#"Reception" * "airEPA" > 0',
    "aw": '"Reception" * "airWPA"', "awup": '#"airWPA" > 0', "awcup": '#"Reception" * "airWPA" > 0',
    "ye": '"Reception" * "yacEPA"', "yecup": '#"Reception" * "yacEPA" > 0',
    "yw": '"Reception" * "yacWPA"', "ywcup": '#"Reception" * "yacWPA" > 0',
}
_DRIVES = "count(distinct coalesce(cast(\"GameID\" as varchar), 'NA') || '-' || coalesce(cast(\"Drive\" as varchar), 'NA')) dr"


def pass_split(src: str, keys: str, side: str) -> str:
    """Passing (``Pass``) or receiving (``Rec``) statistics."""
    p = side == "Pass"
    att, comp = ("Att", "Comp") if p else ("Tgt", "Rec")
    caught, pick = ("Comp", "INTs") if p else ("Caught", "Rec_INTs")
    m: dict[str, str] = {
        "Pass_Attempts" if p else "Targets": "n", "Completions" if p else "Receptions": "c",
        f"{side}_Drives": "dr", f"{comp}_Perc": _div("c", "n"), f"{side}_Yards_Gained": "y",
        "Total_AirYards": "ay", f"Total_AirYards_{comp}": "ayc", "Total_YardsAfterCatch": "yac",
        "PACR" if p else "RACR": _div("y", "ay"), pick: "pick", f"{side}_TDs": "td", "Air_TDs": "atd",
        "Air_TD_Rate": _div("atd", "td"), "TD_to_INT": _div("td", "pick"),
        f"{side}_EPA": "e", f"{side}_WPA": "w", f"{caught}_EPA": "ec", f"{caught}_WPA": "wc",
        f"{side}_Success_Rate": _div("eup", "n"), f"{side}_Win_Rate": _div("wup", "n"),
        f"EPA_{comp}_Perc": _div("ec", "eabs"), f"WPA_{comp}_Perc": _div("wc", "wabs"),
        f"{side}_Clutch_EPA": "clutch", "Total_airEPA": "ae", "Total_airWPA": "aw",
        "Total_yacEPA": "ye", "Total_yacWPA": "yw",
        "air_Success_Rate": _div("aeup", "n"), f"air_{comp}_Success_Rate": _div("aecup", "n"),
        "air_Win_Rate": _div("awup", "n"), f"air_{comp}_Win_Rate": _div("awcup", "n"),
        "yac_Success_Rate": _div("yecup", "n"), "yac_Win_Rate": _div("ywcup", "n"),
    }
    stems = {"Yards": "y", "AirYards": "ay", f"AirYards_{comp}": "ayc", "YardsAfterCatch": "yac",
             "TD": "td", "Air_TD": "atd", pick: "pick", f"{side}_EPA": "e", f"{side}_WPA": "w",
             f"{caught}_EPA": "ec", f"{caught}_WPA": "wc", f"{side}_Clutch_EPA": "clutch",
             "airEPA": "ae", "airWPA": "aw", "yacEPA": "ye", "yacWPA": "yw"}
    if p:
        stems["Times_Hit"] = "hit"
        m["Times_Hit"] = "hit"
    for stem, total in stems.items():
        m[f"{stem}_per_{att}"] = _div(total, "n")
        m[f"{stem}_per_{comp}"] = _div(total, "c")
        m[f"{stem}_per_Drive{'s' if 'Clutch' in stem else ''}"] = _div(total, "dr")
    if p:
        m["TD_per_Att"] = _div("atd", "n")
        m["Passer_Rating"] = (
            f"((({_div('c','n')} - cast(0.3 as double)) * 5) + (({_div('y','n')} - 3) * cast(0.25 as double))"
            f" + ({_div('atd','n')} * 20) + (cast(2.375 as double) - {_div('pick','n')} * 25)) / 6 * 100"
        )
    cols = ", ".join(f'{x} "{n}"' for n, x in m.items())
    return (f"select {keys}, {cols} from (select {keys}, count(*) n, {_DRIVES}, "
            f"{_totals(_PASS_TOTALS)} from {src} group by {keys})")


def rush_split(src: str, keys: str) -> str:
    totals = {
        "sk": '@"Sack"', "y": '"Yards_Gained"', "sy": '"Sack" * "Yards_Gained"', "td": '@"Touchdown"',
        "fu": '@"Fumble"', "clutch": '"EPA" * abs("WPA")',
        "e": '"EPA"', "eup": '#"EPA" > 0', "ep": 'case when "EPA" > 0 then "EPA" when "EPA" <= 0 then 0 end', "eabs": 'abs("EPA")',
        "w": '"WPA"', "wup": '#"WPA" > 0', "wp": 'case when "WPA" > 0 then "WPA" when "WPA" <= 0 then 0 end', "wabs": 'abs("WPA")',
    }
    m = {"Rushes": "n", "Sacks": "sk", "Rush_Drives": "dr", "Rush_Yards_Gained": "y", "Sack_Yards_Lost": "sy",
         "Rush_TDs": "td", "Rush_EPA": "e", "Rush_WPA": "w", "Fumbles": "fu", "Rush_Clutch_EPA": "clutch",
         "Rush_Success_Rate": _div("eup", "n"), "Rush_Win_Rate": _div("wup", "n"),
         "Pos_EPA_Ratio": _div("ep", "eabs"), "Pos_WPA_Ratio": _div("wp", "wabs")}
    for stem, total in {"Rush_Yards": "y", "Rush_TD": "td", "Rush_EPA": "e", "Rush_WPA": "w",
                        "Fumbles": "fu", "Rush_Clutch_EPA": "clutch"}.items():
        m[f"{stem}_per_Rush"] = _div(total, "n")
        m[f"{stem}_per_Drive"] = _div(total, "dr")
    cols = ", ".join(f'{x} "{n}"' for n, x in m.items())
    return (f"select {keys}, {cols} from (select {keys}, count(*) n, {_DRIVES}, "
            f"{_totals(totals)} from {src} group by {keys})")


def qb_table(passes: str = "passes", rushes: str = "rushes") -> str:
    return f"""
select coalesce(p."Season", r."Season") "Season", coalesce(p.nm, r.nm) "Player_ID_Name", 'QB' "Position",
 coalesce(pa, 0) "Pass_Attempts", coalesce(ra, 0) "Rush_Attempts", coalesce(sk, 0) "Sacks",
 coalesce(pa, 0) + coalesce(ra, 0) + coalesce(sk, 0) "Total_Plays"
from (select "Season", "Passer_ID_Name" nm, count(*) pa from {passes} group by all) p
full join (select "Season", "Rusher_ID_Name" nm, count(*) - cast(sum("Sack") as bigint) ra, cast(sum("Sack") as bigint) sk
 from {rushes} where "Rusher_Position" = 'QB' group by all) r on p."Season" = r."Season" and p.nm = r.nm
"""


def skill_table(pos: str, passes: str = "passes", rushes: str = "rushes") -> str:
    wanted = "('RB', 'FB')" if pos == "RB" else f"('{pos}')"
    return f"""
select coalesce(p."Season", r."Season") "Season", coalesce(p.nm, r.nm) "Player_ID_Name", '{pos}' "Position",
 coalesce(rc, 0) "Receptions", coalesce(tg, 0) "Targets", coalesce(ra, 0) "Rush_Attempts",
 coalesce(rc, 0) + coalesce(tg, 0) + coalesce(ra, 0) "Total_Plays"
from (select "Season", "Receiver_ID_Name" nm, cast(sum("Reception") as bigint) rc, count(*) tg from {passes}
 where "Receiver_Position" in {wanted} group by all) p
full join (select "Season", "Rusher_ID_Name" nm, count(*) ra from {rushes}
 where "Rusher_Position" in {wanted} group by all) r on p."Season" = r."Season" and p.nm = r.nm
"""


CTES["QB_t"] = qb_table()
for _p in ("RB", "WR", "TE"):
    CTES[f"{_p}_t"] = skill_table(_p)

CTES["qb_team"] = """
select *, Team_Pass_Attempts + Team_Rush_Attempts + Team_Sacks "Team_Total_Plays",
 "Pass_Attempts" / cast(Team_Pass_Attempts as double) "Perc_Pass_Attempts",
 "Rush_Attempts" / cast(Team_Rush_Attempts as double) "Perc_Rush_Attempts",
 "Sacks" / cast(Team_Sacks as double) "Perc_Sacks",
 "Total_Plays" / cast(Team_Pass_Attempts + Team_Rush_Attempts + Team_Sacks as double) "Perc_Total_Plays"
from (select *, cast(sum("Pass_Attempts") over t as bigint) "Team_Pass_Attempts",
 cast(sum("Rush_Attempts") over t as bigint) "Team_Rush_Attempts", cast(sum("Sacks") over t as bigint) "Team_Sacks"
from (select coalesce(p."Season", r."Season") "Season", coalesce(p.nm, r.nm) "Player_ID_Name",
 coalesce(p.posteam, r.posteam) posteam, 'QB' "Position",
 coalesce(pa, 0) "Pass_Attempts", coalesce(ra, 0) "Rush_Attempts", coalesce(sk, 0) "Sacks",
 coalesce(pa, 0) + coalesce(ra, 0) + coalesce(sk, 0) "Total_Plays"
from (select "Season", posteam, "Passer_ID_Name" nm, count(*) pa from passes group by all) p
full join (select "Season", posteam, "Rusher_ID_Name" nm, count(*) - cast(sum("Sack") as bigint) ra, cast(sum("Sack") as bigint) sk
 from rushes where "Rusher_Position" = 'QB' group by all) r
 on p."Season" = r."Season" and p.nm = r.nm and p.posteam is not distinct from r.posteam)
window t as (partition by "Season", posteam))
"""


def pos_team(pos: str) -> str:
    wanted = "('RB', 'FB')" if pos in ("RB", "FB") else f"('{pos}')"
    return f"""
select *, "Team_Targets" + "Team_Rush_Attempts" "Team_Total_Plays",
 "Targets" / cast("Team_Targets" as double) "Perc_Targets",
 "Rush_Attempts" / cast("Team_Rush_Attempts" as double) "Perc_Rush_Attempts",
 "Total_Plays" / cast("Team_Targets" + "Team_Rush_Attempts" as double) "Perc_Total_Plays"
from (select *, cast(sum("Targets") over t as bigint) "Team_Targets", cast(sum("Rush_Attempts") over t as bigint) "Team_Rush_Attempts"
from (select coalesce(p."Season", r."Season") "Season", coalesce(p.nm, r.nm) "Player_ID_Name",
 coalesce(p.posteam, r.posteam) posteam, '{pos}' "Position", coalesce(tg, 0) "Targets", coalesce(ra, 0) "Rush_Attempts",
 coalesce(tg, 0) + coalesce(ra, 0) "Total_Plays"
from (select "Season", posteam, "Receiver_ID_Name" nm, count(*) tg from passes where "Receiver_Position" in {wanted} group by all) p
full join (select "Season", posteam, "Rusher_ID_Name" nm, count(*) ra from rushes where "Rusher_Position" in {wanted} group by all) r
 on p."Season" = r."Season" and p.nm = r.nm and p.posteam is not distinct from r.posteam)
window t as (partition by "Season", posteam))
"""


def roster_rule(depth: int, positions: tuple[str, ...], kind: str) -> str:
    if "QB" in positions:
        src, nm, cond = "passes", "Passer_ID_Name", "true"
    elif kind == "rush":
        src, nm = "rushes", "Rusher_ID_Name"
    else:
        src, nm = "passes", "Receiver_ID_Name"
    if "QB" not in positions:
        col = "Rusher_Position" if kind == "rush" else "Receiver_Position"
        cond = f"\"{col}\" in ({', '.join(repr(p) for p in positions)})"
    return f"""
select distinct "Season", nm "Player_ID_Name" from (
 select *, row_number() over (partition by "Season", posteam order by n desc, nm) k
 from (select "Season", posteam, "{nm}" nm, count(*) n from {src} where {cond} group by all)) where k >= {depth}
"""


def league_rule(depth: int, position: str, attempts: str, combine: bool = False, teams: int = 32) -> str:
    parts = {"QB": ["QB"], "RB": ["RB"], "FB": ["RB"]}.get(position) or ([position] if not combine else ["TE", "WR"])
    main = "Pass_Attempts" if position == "QB" else "Targets"
    union = " union all ".join(
        f'select "Season", "Player_ID_Name", {i} part, "{attempts}" a, case when "{main}" = 0 then 1 else 0 end side from {p}_t'
        for i, p in enumerate(parts))
    return f"""
select distinct "Season", "Player_ID_Name" from (
 select *, row_number() over (partition by "Season" order by a desc, part, side, "Player_ID_Name") k,
  count(*) over (partition by "Season") n from ({union})) where k >= least({depth * teams + 1}, n)
"""


def share_rule(share: str, cutoff: float) -> str:
    return f"""
select "Season", "Player_ID_Name" from qb_team group by all
having count(*) filter (where not isnan("{share}") and "{share}" >= cast({cutoff} as double)) = 0
"""


CTES["game_one"] = """
select distinct "Season", "Passer_ID_Name" "Player_ID_Name" from passes where posteam is not null
and ("Season", "Passer_ID_Name") not in (select ("Season", "Passer_ID_Name") from (
 select "Season", "Passer_ID_Name", row_number() over (partition by "Season", posteam
  order by "GameID", "TimeSecs" desc nulls last, "Passer_ID_Name") k
 from passes where posteam is not null and qtr = 1) where k = 1)
"""
RULES = {
    "QB": share_rule("Perc_Total_Plays", 0.1),
    "RB_rec": league_rule(3, "RB", "Targets"),
    "WR_rec": league_rule(4, "WR", "Targets"),
    "TE_rec": league_rule(2, "TE", "Targets"),
    "RB_rush": league_rule(3, "RB", "Rush_Attempts"),
    "WR_TE_rush": league_rule(1, "WR", "Rush_Attempts", combine=True),
}
for _r, _sql in RULES.items():
    CTES[f"s_{_r}"] = _sql


def _in(role: str, name: str, t: str = "x") -> str:
    return f'({t}."Season", {t}."{name}") in (select ("Season", "Player_ID_Name") from s_{role})'


def _label(name: str, roles: list[str], t: str = "x") -> str:
    whens = " ".join(f"when {_in(r, name, t)} then 'Replacement_{r}'" for r in roles)
    return f'case {whens} else {t}."{name}" end'


CTES["pooled_passes"] = f"""
select x.* replace ({_label('Passer_ID_Name', ['QB'])} as "Passer_ID_Name",
 {_label('Receiver_ID_Name', ['RB_rec', 'WR_rec', 'TE_rec'])} as "Receiver_ID_Name") from passes x
"""
CTES["pooled_rushes"] = f"""
select x.* replace ({_label('Rusher_ID_Name', ['RB_rush', 'WR_TE_rush', 'QB'])} as "Rusher_ID_Name") from rushes x
"""
CTES["QB_f"] = f"""
select x.*, case when {_in('QB', 'Player_ID_Name')} then 1 else 0 end "Replacement_Level",
 {_label('Player_ID_Name', ['QB'])} "Player_Model_ID" from QB_t x
"""
for _p, (_rec, _rush) in {"RB": ("RB_rec", "RB_rush"), "WR": ("WR_rec", "WR_TE_rush"), "TE": ("TE_rec", "WR_TE_rush")}.items():
    CTES[f"{_p}_f"] = f"""
select x.*, case when {_in(_rec, 'Player_ID_Name')} then 1 else 0 end "Replacement_Level_Receiver",
 case when {_in(_rush, 'Player_ID_Name')} then 1 else 0 end "Replacement_Level_Rusher",
 {_label('Player_ID_Name', [_rec])} "Player_Model_ID_Rec", {_label('Player_ID_Name', [_rush])} "Player_Model_ID_Rush" from {_p}_t x
"""

THETA = 0.25


def oneway(src: str, level: str, y: str, where: str = "true", keys: str = '"Season"') -> str:
    """Effects and conditional sds of a one-way random-intercept model with a given sd ratio."""
    t2 = f"cast({THETA * THETA} as double)"
    return f"""
select {keys}, lv, {t2} * n / (1 + {t2} * n) * (m - mu) est, sqrt(s2 * {t2} / (1 + {t2} * n)) sd from (
 select *, sum(ss - 2 * mu * n * m + n * mu * mu - {t2} / (1 + {t2} * n) * (n * (m - mu)) ** 2)
   over (partition by {keys}) / (sum(n) over (partition by {keys}) - 1) s2 from (
  select *, sum(wt * m) over (partition by {keys}) / sum(wt) over (partition by {keys}) mu from (
   select {keys}, "{level}" lv, cast(count(*) as double) n, avg("{y}") m, sum("{y}" * "{y}") ss,
    count(*) / (1 + {t2} * count(*)) wt from {src} where "{y}" is not null and {where} group by {keys}, "{level}")))
"""


_PAIRS = {
    "air_P": ("pooled_passes", "Passer_ID_Name", "airWPA_Result", "true"),
    "yac_P": ("pooled_passes", "Passer_ID_Name", "yacWPA_Result", "true"),
    "rush_P": ("pooled_rushes", "Rusher_ID_Name", "WPA", "\"Rusher_Position\" = 'QB'"),
    "air_R": ("pooled_passes", "Receiver_ID_Name", "airWPA_Result", "true"),
    "yac_R": ("pooled_passes", "Receiver_ID_Name", "yacWPA_Result", "true"),
    "rush_R": ("pooled_rushes", "Rusher_ID_Name", "WPA", "\"Rusher_Position\" <> 'QB'"),
}
for _k, _a in _PAIRS.items():
    CTES[f"u_{_k}"] = oneway(*_a)


def _valued(pos: str, fits: str = "u") -> str:
    qb = pos == "QB"
    s = "P" if qb else "R"
    rec = "Player_Model_ID" if qb else "Player_Model_ID_Rec"
    rush = "Player_Model_ID" if qb else "Player_Model_ID_Rush"
    n_air = '"Pass_Attempts"' if qb else '"Targets"'
    n_rush = '("Rush_Attempts" + "Sacks")' if qb else '"Rush_Attempts"'
    return f"""
select x."Season", x."Player_ID_Name", x."Position", x."{rec}" rec_id, x."{rush}" rush_id,
 cast({n_air} as double) n_air, cast({n_rush} as double) n_rush,
 coalesce(a.est, 0) "air_iPA", coalesce(y.est, 0) "yac_iPA", coalesce(r.est, 0) "rush_iPA",
 coalesce(a.sd, 0) air_sd, coalesce(y.sd, 0) yac_sd, coalesce(r.sd, 0) rush_sd,
 {n_air} * coalesce(a.est, 0) "air_iPAA", {n_air} * coalesce(y.est, 0) "yac_iPAA", {n_rush} * coalesce(r.est, 0) "rush_iPAA"
from {pos}_f x left join {fits}_air_{s} a on a."Season" = x."Season" and a.lv = x."{rec}"
left join {fits}_yac_{s} y on y."Season" = x."Season" and y.lv = x."{rec}"
left join {fits}_rush_{s} r on r."Season" = x."Season" and r.lv = x."{rush}"
"""


def _above(pos: str, valued: str = "v") -> str:
    roles = {"QB": ("QB", "QB"), "RB": ("RB_rec", "RB_rush"), "WR": ("WR_rec", "WR_TE_rush"), "TE": ("TE_rec", "WR_TE_rush")}
    rec, rush = roles[pos]
    return f"""
select *, "air_iPAR" + "yac_iPAR" + "rush_iPAR" "total_iPAR" from (
select v.*, "air_iPAA" - n_air * max(case when rec_id = 'Replacement_{rec}' then "air_iPA" end) over s "air_iPAR",
 "yac_iPAA" - n_air * max(case when rec_id = 'Replacement_{rec}' then "yac_iPA" end) over s "yac_iPAR",
 "rush_iPAA" - n_rush * max(case when rush_id = 'Replacement_{rush}' then "rush_iPA" end) over s "rush_iPAR"
from {pos}_{valued} v window s as (partition by "Season"))
"""


for _p in ("QB", "RB", "WR", "TE"):
    CTES[f"{_p}_v"] = _valued(_p)
    CTES[f"{_p}_a"] = _above(_p)
CTES["above"] = " union all ".join(f"select * from {p}_a" for p in ("QB", "RB", "WR", "TE"))
CTES["valued"] = " union all ".join(f"select * from {p}_v" for p in ("QB", "RB", "WR", "TE"))
CTES |= crossed.CTES
for _k, _m, _f in (("air_P", "air", "Passer"), ("yac_P", "yac", "Passer"), ("rush_P", "qb_rush", "Rusher"),
                   ("air_R", "air", "Receiver"), ("yac_R", "yac", "Receiver"), ("rush_R", "main_rush", "Rusher")):
    CTES[f"c_{_k}"] = f"select * from mme_fit where model = '{_m}' and factor = '{_f}_ID_Name'"
for _p in ("QB", "RB", "WR", "TE"):
    CTES[f"{_p}_vc"] = _valued(_p, "c")
    CTES[f"{_p}_ac"] = _above(_p, "vc")
CTES["valued_given"] = " union all ".join(f"select * from {p}_vc" for p in ("QB", "RB", "WR", "TE"))
CTES["above_given"] = " union all ".join(f"select * from {p}_ac" for p in ("QB", "RB", "WR", "TE"))
CTES["ppw"] = 'select "Season", 1 / regr_slope("Wins", "Total_Score_Diff") price from standings group by "Season"'


def draws(units: str, sims: int, first: int = 1) -> str:
    """Hashed draws with replacement from numbered units (Season, posteam, u)."""
    return f"""
select "Season", posteam, sim_id, u, count(*) copies from (
 select x."Season", x.posteam, s.sim_id,
  1 + cast(('0x' || substr(md5(concat_ws('|', '{SEED}', cast(s.sim_id as varchar), cast(x."Season" as varchar), x.posteam, cast(x.u as varchar))), 1, 15)) as bigint) % max(x.u) over (partition by x."Season", x.posteam) u
 from {units} x, (select cast(unnest(generate_series({first}, {first + sims - 1})) as int) sim_id) s)
group by all
"""


SIMS = 4
CTES["drive_units"] = """
select *, row_number() over (partition by "Season", posteam order by gd) u from (
 select distinct "Season", posteam, coalesce(cast("GameID" as varchar), 'NA') || '-' || coalesce(cast("Drive" as varchar), 'NA') gd
 from annot where posteam is not null)
"""
CTES["drive_draws"] = draws("drive_units", SIMS)
CTES["drive_copies"] = 'select d.*, gd from drive_draws d join drive_units using ("Season", posteam, u)'
PLAY_ORDER = ["GameID", "Drive", "qtr", "TimeSecs", "DefensiveTeam", "PlayType", "Passer_ID",
              "Receiver_ID", "Rusher_ID", "Yards_Gained", "EPA", "AirYards", "Reception"]
CTES["play_units"] = f"""
select *, row_number() over (partition by "Season", posteam order by {', '.join(f'"{c}" nulls first' for c in PLAY_ORDER)}) u
from plays where posteam is not null
"""
CTES["play_draws"] = draws("play_units", SIMS)
CTES["sim_passes"] = """
select p.*, sim_id, copies from passes p join drive_copies d on d."Season" = p."Season" and d.posteam = p.posteam
 and gd = coalesce(cast("GameID" as varchar), 'NA') || '-' || coalesce(cast("Drive" as varchar), 'NA')
"""
CTES["sim_rushes"] = CTES["sim_passes"].replace("from passes p", "from rushes p")
# One row per copy: replicates in their unweighted form.
CTES["sim_passes_rows"] = "select * from sim_passes, lateral (select unnest(generate_series(1, copies)) c)"
CTES["sim_rushes_rows"] = "select * from sim_rushes, lateral (select unnest(generate_series(1, copies)) c)"


def compose(final: str) -> str:
    """Prefix ``final`` with the expressions it depends on."""
    order = list(CTES)
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in order:
            if name not in needed and re.search(rf"(?<![\w.\"]){name}(?![\w\"(])", text):
                needed.add(name)
                visit(CTES[name])

    visit(final)
    if not needed:
        return final
    body = ",\n".join(f"{n} as materialized ({CTES[n].strip()})" for n in order if n in needed)
    return f"with {body}\n{final.strip()}"
