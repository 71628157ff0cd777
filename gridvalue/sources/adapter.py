"""Play-by-play, roster and game tables derived from an order/line-item star schema.

Every measure is a multiple of a power of two, so sums do not depend on the
order in which Spark adds them. Orders meet their customers before line items meet
orders, so a line item is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import join_side, spread

PLAYS_SQL = """
with b as (
 select l.l_orderkey, l.l_partkey, l.l_linenumber, l.l_returnflag, l.l_linestatus,
  cast(l.l_quantity as int) q, cast(round(l.l_discount*100) as int) d, cast(round(l.l_tax*100) as int) t,
  o.season, s.s_nationkey snk, ns.n_name pt, o.dt,
  case when l.l_returnflag='R' or (l.l_returnflag='A' and l.l_linestatus='O') then 'Pass'
       when l.l_returnflag='N' then 'Run' else 'Sack' end pty,
  case when cast(l.l_quantity as int)<=30 then 0 when cast(l.l_quantity as int)<=44 then 1 when cast(l.l_quantity as int)<=48 then 2 else 3 end qi,
  case when l.l_linestatus='O' then 1 else 0 end rc
 from {lineitem} l join {supplier} s on l.l_suppkey=s.s_suppkey join {nation} ns on s.s_nationkey=ns.n_nationkey
 join (select o_orderkey, cast(year(o_orderdate) as int) season, n_name dt from {orders} join {customer} on o_custkey=c_custkey
  join {nation} on c_nationkey=n_nationkey) o on l.l_orderkey=o.o_orderkey)
select season Season, l_orderkey GameID, l_linenumber Drive, 1 + l_linenumber % 4 qtr,
 cast(3600 - 60*l_linenumber - q as double) TimeSecs,
 case when q=50 and l_linenumber=7 then null else pt end posteam, dt DefensiveTeam,
 case when l_orderkey % 2 = 0 then pt else dt end HomeTeam,
 case when q=13 then null when l_linenumber % 3 = 0 then '(Shotgun) play' when l_linenumber % 3 = 1 then '(No Huddle, Shotgun) play' else 'play' end `desc`,
 pty PlayType,
 case when pty='Run' then 'None' else concat('Q-', cast(snk*10+qi as varchar(20))) end Passer_ID,
 case when pty='Run' or q=17 then null when q % 10 = 0 then concat('q.', cast(snk*10+qi as varchar(20))) else concat('Q.', cast(snk*10+qi as varchar(20))) end Passer,
 case when pty='Pass' then concat('P-', cast(l_partkey as varchar(20))) else 'None' end Receiver_ID,
 case when pty='Pass' then concat('P.', cast(l_partkey as varchar(20))) end Receiver,
 case when pty<>'Run' then 'None' when q % 9 = 0 then concat('Q-', cast(snk*10+qi as varchar(20))) else concat('P-', cast(l_partkey as varchar(20))) end Rusher_ID,
 case when pty<>'Run' then null when q % 9 = 0 then concat('Q.', cast(snk*10+qi as varchar(20))) else concat('P.', cast(l_partkey as varchar(20))) end Rusher,
 case when pty<>'Pass' or q=37 then null when l_partkey % 3 = 0 then 'left' when l_partkey % 3 = 1 then 'middle' else 'right' end PassLocation,
 case when pty<>'Run' then null when q % 3 = 0 then 'left' when q % 3 = 1 then 'middle' else 'right' end RunLocation,
 case when pty<>'Run' or q % 3 = 1 then null when l_linenumber % 3 = 0 then 'end' when l_linenumber % 3 = 1 then 'guard' else 'tackle' end RunGap,
 case when pty='Pass' then rc else 0 end Reception,
 case when pty='Pass' then cast(q-10 as double) end AirYards,
 case when pty='Pass' then cast(rc*t as double) end YardsAfterCatch,
 cast(case pty when 'Pass' then rc*(q-10+t) when 'Run' then q % 12 - 2 else -(q % 9) end as double) Yards_Gained,
 case when pty<>'Run' and q % 7 = 0 then 1 else 0 end QBHit,
 case when pty='Pass' and rc=0 and q % 11 = 0 then 1 else 0 end InterceptionThrown,
 case when (pty='Pass' and rc=1 and q>=47) or (pty='Run' and q>=48) then 1 else 0 end Touchdown,
 case when pty='Sack' then 1 else 0 end Sack,
 case when pty<>'Pass' and q % 23 = 0 then 1 else 0 end Fumble,
 case when q=41 and l_linenumber=6 then null else cast((d-5)*8+q-25 as double)/64 end EPA,
 case when q=41 and l_linenumber=6 then null else cast((d-5)*8+q-25 as double)/4096 end WPA,
 case when pty='Pass' then cast((d-5)*8 as double)/64 end airEPA,
 case when pty='Pass' then cast((d-5)*8 as double)/4096 end airWPA,
 case when pty='Pass' then cast(q-25 as double)/64 end yacEPA,
 case when pty='Pass' then cast(q-25 as double)/4096 end yacWPA
from b
"""

ROSTERS_SQL = """
select concat('P-', cast(p_partkey as varchar(20))) GSIS_ID,
 case p_type when 'MEDIUM' then 'WR' when 'STANDARD' then 'WR' when 'LARGE' then 'TE' when 'PROMO' then 'RB' else 'FB' end Pos
from {part} where p_type <> 'ECONOMY'
union all
select concat('Q-', cast(n_nationkey*10+i as varchar(20))), 'QB'
from {nation} lateral view explode(array(0,1,2,3)) x as i
"""

GAMES_SQL = """
select o_orderkey GameID, cast(year(o_orderdate) as int) Season, nc.n_name home, ns.n_name away,
 cast(o_orderkey % 35 as int) homescore, cast((o_custkey*7) % 31 as int) awayscore
from {orders} join {customer} on o_custkey=c_custkey join {nation} nc on c_nationkey=nc.n_nationkey
join {nation} ns on ns.n_nationkey=(c_nationkey+1+o_orderkey % 24) % 25
"""


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = ("lineitem", "orders", "supplier", "nation", "customer", "part")
    used = [n for n in names if f"{{{n}}}" in sql]
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in used}
    if "lineitem" in tables:
        tables["lineitem"] = spread(tables["lineitem"])
    for n in ("customer", "supplier"):
        if n in tables:
            tables[n] = join_side(tables[n])
    return spark.sql(sql, **tables)


def plays_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One play per line item."""
    return _run(spark, sf_dir, PLAYS_SQL)


def rosters_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listed position per part, plus four quarterbacks per nation."""
    return _run(spark, sf_dir, ROSTERS_SQL).distinct()


def games_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One game per order."""
    return _run(spark, sf_dir, GAMES_SQL)
