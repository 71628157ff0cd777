"""Joins of plays with large tables of players: same rows, fewer plays shuffled."""

import pytest

from gridvalue import functions
from gridvalue.functions import storage
from gridvalue.operators import preparation, replacement, splits
from gridvalue.operators.tables import SeasonTables
from gridvalue.plans import season
from gridvalue.registry import RAW_TEXT

from helpers import frame, plays, values


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def few_rows(monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(storage, "FREQUENT_KEYS", 2)


def test_rows_of_frequent_keys_are_not_merged(spark, few_rows):
    rows = frame(spark, [{"k": k, "s": s, "x": i} for i, (k, s) in enumerate(
        [("None", 1)] * 9 + [(None, 1)] * 7 + [("a", 1), ("a", 2), ("b", 1), ("c", None), ("c", 2)])],
        {"k": "string", "s": "int", "x": "int"})
    table = storage.settle(frame(spark, [
        {"id": i, "s": s, "v": v} for i, s, v in [("None", 1, "n"), ("a", 1, "p"), ("a", 1, "q"), (None, 1, "m"),
                                                  ("c", None, "z"), ("d", 1, "y")]],
        {"id": "string", "s": "int", "v": "string"}), "players")
    on = {"k": "id", "s": "s"}
    whole = functions.null_safe_join(rows, table, on)
    out = storage.attach(rows, table, on)
    assert out.columns == whole.columns
    assert values(out, *out.columns) == values(whole, *whole.columns)
    assert "Union" in executed(out) and executed(out).count("SortMergeJoin") == 1


def test_parts_are_tables_of_their_own(spark):
    parts = {k: frame(spark, [{"x": i} for i in range(n)], {"x": "int"}) for k, n in (("A", 900), ("B", 2), ("C", 0))}
    out = storage.settle_parts(parts, "parts")
    assert {k: t.count() for k, t in out.items()} == {"A": 900, "B": 2, "C": 0}
    assert all(t.columns == ["x"] for t in out.values())
    sizes = [int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in out.values()]
    assert sizes[1] < sizes[0] / 3


def replaced(spark):
    """Players of several positions, above and at replacement level, and none at all."""
    rows = [{"Season": s, "Passer_ID_Name": f"q{i % 3}", "Receiver_ID_Name": r, "Receiver_Position": p,
             "Rusher_ID_Name": r, "Rusher_Position": p, "EPA": 1.0}
            for s in (1, 2) for i, (r, p) in enumerate(
                [(f"{p}{i}", p) for p in ("RB", "WR", "TE", "FB", None) for i in range(5)]
                + [("RB1", "WR"), ("WR2", "TE"), (None, "WR")])]
    types = {"Season": "int", "Passer_ID_Name": "string", "Receiver_ID_Name": "string", "Receiver_Position": "string",
             "Rusher_ID_Name": "string", "Rusher_Position": "string", "EPA": "double"}
    sets = [(s, n, r) for s in (1, 2) for n, r in
            [(f"{p}{i}", f"{p}_rec") for p in ("RB", "WR", "TE") for i in range(s, 5)]
            + [(f"RB{i}", "RB_rush") for i in range(3)] + [("WR4", "WR_TE_rush"), ("q1", "QB"), ("TE3", "RB_rush")]]
    listed = frame(spark, [dict(Season=s, Player_ID_Name=n, role=r) for s, n, r in sets],
                   {"Season": "int", "Player_ID_Name": "string", "role": "string"})
    return replacement._relabel(
        SeasonTables(passing=frame(spark, rows, types), rushing=frame(spark, rows, types)), listed, ["Season"])


def test_many_replacement_players_are_relabelled_alike_without_a_merge(spark, monkeypatch):
    cols = ("Season", "Passer_ID_Name", "Receiver_ID_Name", "Receiver_Position", "Rusher_ID_Name", "Rusher_Position")
    small = replaced(spark)
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 15)
    large = replaced(spark)
    for a, b in ((small.passing, large.passing), (small.rushing, large.rushing)):
        assert sorted(a.columns) == sorted(b.columns)
        assert values(a, *cols) == values(b, *cols)
        assert "SortMergeJoin" not in executed(b)


def test_drives_are_counted_apart_from_the_totals(spark):
    p = plays(spark, [{"GameID": g, "Drive": d, "Passer_ID_Name": n, "EPA": 0.5} for g in (1, 2, None) for d in (1, 1, None)
                      for n in ("a", None)], Passer_ID_Name="string", airEPA_Result="double")
    out = splits.passing_splits(p, ["Season", "Passer_ID_Name"])
    assert values(out, "Passer_ID_Name", "Pass_Attempts", "Pass_Drives") == [("a", 9, 6), (None, 9, 6)]
    # Totals go by split, not by split and drive.
    assert "GameID" not in "".join(x for x in executed(out).splitlines() if "partial_sum" in x)


def test_players_of_plays_are_attached_alike(spark, few_rows):
    p = plays(spark, [{"Passer_ID": "None" if i % 2 else f"q{i % 3}", "Passer": f"n{i % 3}", "Receiver_ID": f"r{i % 7}" if i % 2 else "None",
                       "Receiver": "x", "Rusher_ID": None if i % 5 else f"r{i % 6}", "Rusher": "y", "PlayType": ("Sack", "Pass", "Run")[i % 3]}
                      for i in range(60)])
    rosters = frame(spark, [{"GSIS_ID": f"r{i}", "Pos": q, "Season": 2015} for i in range(6) for q in ("WR", "RB")[:1 + i % 2]],
                    {"GSIS_ID": "string", "Pos": "string", "Season": "int"})
    names = preparation.sack_as_rush(preparation.id_name(preparation.fix_team_code(p)))
    single = preparation.roster_positions(names, rosters).drop("Passer_Name", "Receiver_Name", "Rusher_Name")
    whole = preparation.add_positions(p, rosters)
    assert whole.columns == single.columns
    assert values(whole, *whole.columns) == values(single, *single.columns)


def test_texts_that_no_query_reads_are_not_joined(spark, monkeypatch):
    plans, settle = {}, storage.settle
    monkeypatch.setattr(season, "settle", lambda df, name, **more: plans.update({name: executed(df)}) or settle(df, name, **more))
    p = plays(spark, [{"Passer_ID": "q", "Passer": "n", "PlayType": "Pass", "HomeTeam": "A", "posteam": "A", "desc": "(Shotgun)"}])
    p = storage.settle(p, "plays")
    rosters = frame(spark, [{"GSIS_ID": "q", "Pos": "QB", "Season": 2015}], {"GSIS_ID": "string", "Pos": "string", "Season": "int"})
    out = season.model_plays(p, rosters, drop=RAW_TEXT)
    assert values(out, "Passer_ID_Name", "Passer_Position", "Home_Ind", "Shotgun_Ind") == [("n-q", "QB", 1, 1)]
    assert not set(RAW_TEXT) & set(out.columns)
    scans = [x for x in plans["model_plays"].splitlines() if "FileScan" in x and "GameID" in x]
    assert scans and not [x for x in scans if "Passer#" in x]
