"""Plays go through joins once, as narrow rows, and large tables of players are merged."""

from datetime import date

import pytest

from gridvalue.functions import storage
from gridvalue.operators import preparation, replacement
from gridvalue.operators.tables import SeasonTables
from gridvalue.plans import season
from gridvalue.registry import RAW_TEXT
from gridvalue.sources import plays_from_tables

from helpers import frame, plays, values


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def below(plan, text):
    """The lines of a plan under each one that holds ``text``."""
    lines = plan.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    out = []
    for i, line in enumerate(lines):
        if text in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i + 1:end]))
    return out


@pytest.fixture
def folder(spark, tmp_path):
    tables = {
        "nation": ("n_nationkey int, n_name string", [(0, "A"), (1, "B"), (1, "C")]),
        "supplier": ("s_suppkey int, s_nationkey int", [(1, 0), (2, 1), (3, None)]),
        "customer": ("c_custkey int, c_nationkey int", [(1, 0), (2, 1), (2, 0), (3, 1), (None, 1)]),
        "orders": ("o_orderkey int, o_custkey int, o_orderdate date", [
            (1, 1, date(1995, 1, 2)), (2, 2, date(1996, 1, 2)), (3, None, date(1996, 1, 2)), (4, 3, None), (4, 3, date(1997, 1, 1))]),
        "lineitem": (
            "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_returnflag string, l_linestatus string,"
            " l_quantity double, l_discount double, l_tax double",
            [(o, p, s, 1, "R", "F", 7.0, 0.05, 0.02) for o in (1, 2, 3, 4, None) for p, s in ((10, 1), (11, 2), (12, 3))]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_line_items_do_not_go_along_to_the_customers(spark, folder, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 4)
    out = plays_from_tables(spark, folder)
    # Customer 2 and nation 1 are listed twice; supplier 3 has no nation.
    assert values(out, "GameID", "Season", "posteam", "DefensiveTeam", "Receiver_ID") == sorted([
        *[(1, 1995, p, "A", r) for p, r in (("A", "P-10"), ("B", "P-11"), ("C", "P-11"))],
        *[(2, 1996, p, d, r) for p, r in (("A", "P-10"), ("B", "P-11"), ("C", "P-11")) for d in "ABC"],
        *[(4, s, p, d, r) for s in (None, 1997) for p, r in (("A", "P-10"), ("B", "P-11"), ("C", "P-11")) for d in "BC"],
    ], key=repr)
    to_customers = below(executed(out), "hashpartitioning(o_custkey")
    assert to_customers and not [x for x in to_customers if "l_orderkey" in x]


def test_texts_are_read_before_plays_are_joined(spark, monkeypatch):
    joined = []
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(season, "add_positions", lambda p, *a: joined.append(p.columns) or preparation.add_positions(p, *a))
    p = storage.settle(plays(spark, [
        {"Receiver_ID": "r", "Receiver": "n", "PlayType": "Pass", "HomeTeam": h, "posteam": "A", "desc": d}
        for h, d in (("A", "(Shotgun)"), ("B", "(No Huddle, Shotgun)"), (None, None))]), "plays")
    rosters = frame(spark, [{"GSIS_ID": "r", "Pos": "WR", "Season": 2015}], {"GSIS_ID": "string", "Pos": "string", "Season": "int"})
    out = season.model_plays(p, rosters, drop=RAW_TEXT)
    flags = ["Shotgun_Ind", "No_Huddle_Ind", "Home_Ind"]
    assert values(out, *flags, "Receiver_Position") == [(0, 0, None, "WR"), (1, 0, 1, "WR"), (1, 1, 0, "WR")]
    assert out.columns.index("Shotgun_Ind") == out.columns.index("Rusher_Position") + 1
    assert set(flags) <= set(joined[0])


def test_many_replacement_players_are_not_broadcast_to_their_tables(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 3)
    types = {"Season": "int", "Player_ID_Name": "string", "Position": "string"}
    players = frame(spark, [{"Season": 1, "Player_ID_Name": f"p{i}", "Position": "QB"} for i in range(6)], types)
    sets = frame(spark, [{"Season": 1, "Player_ID_Name": f"p{i}", "role": r} for i in range(5) for r in ("QB", "WR_rec")],
                 {"Season": "int", "Player_ID_Name": "string", "role": "string"})
    named = {"Passer_ID_Name": "string", "Receiver_ID_Name": "string", "Rusher_ID_Name": "string"}
    rows = plays(spark, [{}], **named)
    tables = SeasonTables(passing=rows, rushing=rows, qb=players, rb=players, wr=players, te=players)
    out = replacement._relabel(tables, sets, ["Season"])
    assert values(out.qb, "Player_ID_Name", "Replacement_Level") == [(f"p{i}", int(i < 5)) for i in range(6)]
    assert values(out.wr, "Player_Model_ID_Rec") == sorted([("p5",), *[("Replacement_WR_rec",)] * 5], key=repr)
    for table in out.positions().values():
        assert "SortMergeJoin" in executed(table) and "BroadcastHashJoin" not in executed(table)


def test_tables_and_plays_meet_only_the_players_of_their_roles(spark):
    flags = frame(spark, [
        {"Season": 1, "Player_ID_Name": "a", "_QB": True, "_WR_rec": False, "_TE_rec": False},
        {"Season": 1, "Player_ID_Name": "b", "_QB": False, "_WR_rec": True, "_TE_rec": False},
        {"Season": None, "Player_ID_Name": None, "_QB": False, "_WR_rec": False, "_TE_rec": True}],
        {"Season": "int", "Player_ID_Name": "string", "_QB": "boolean", "_WR_rec": "boolean", "_TE_rec": "boolean"})
    out = replacement._flagged(flags, ["Season"], ("WR_rec", "TE_rec"))
    assert values(out, *out.columns) == sorted([(1, "b", True, False), (None, None, False, True)], key=repr)


def test_frequent_players_are_found_without_shuffling_the_table(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(storage, "FREQUENT_KEYS", 2)
    plans, write = {}, storage._write
    monkeypatch.setattr(storage, "_write", lambda df, name, *a, **k: plans.update({name: executed(df)}) or write(df, name, *a, **k))
    rows = frame(spark, [{"k": k, "x": i} for i, k in enumerate(["None"] * 5 + [None] * 4 + ["a", "b"])], {"k": "string", "x": "int"})
    table = storage.settle(frame(spark, [{"id": i, "v": v} for i, v in [(None, "n"), (None, "m"), ("a", "p"), ("c", "q")]],
                                 {"id": "string", "v": "string"}), "players")
    out = storage.attach(rows, table, {"k": "id"})
    assert values(out, "k", "v") == sorted([("None", None)] * 5 + [(None, "n"), (None, "m")] * 4 + [("a", "p"), ("b", None)], key=repr)
    assert not [p for n, p in plans.items() if n in ("frequent_held", "frequent_rows") and "SortMergeJoin" in p]


def test_names_of_passers_come_last_in_plans_but_not_in_columns(spark):
    p = plays(spark, [{"Passer_ID": "q", "Passer": "n", "Receiver_ID": "r", "Receiver": "m"}])
    out = preparation.id_name(p)
    added = [c for c in out.columns if c not in p.columns]
    assert added == [f"{r}_Name" for r in preparation.ROLES] + [f"{r}_ID_Name" for r in preparation.ROLES]
    assert values(out, "Passer_ID_Name", "Receiver_ID_Name", "Rusher_ID_Name") == [("n-q", "m-r", "None-NA")]
    first = next(x for x in executed(out).splitlines() if "Join" in x)
    assert "Passer_ID" in first
