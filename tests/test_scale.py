"""Plans that must hold for tables of any size, read from small ones."""

import pytest
from pyspark.sql import types as T

from gridvalue.functions import storage
from gridvalue.operators import bootstrap, preparation
from gridvalue.sources import readers

from helpers import frame, plays, values


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Plans of the tables that the bootstrap writes, by name."""
    plans, settle = {}, bootstrap.settle

    def noted(df, name, keep=False):
        plans[name] = executed(df)
        return settle(df, name, keep)

    monkeypatch.setattr(bootstrap, "settle", noted)
    return plans


def some_plays(spark):
    rows = [{"GameID": i // 3, "Drive": i % 3, "posteam": "AB"[i % 2], "PlayType": "Pass",
             "Passer_ID_Name": f"p{i % 4}", "EPA": i / 8, "WPA": i / 64} for i in range(60)]
    return plays(spark, rows, Passer_ID_Name="string")


def test_draws_are_never_broadcast(spark, written, monkeypatch):
    p = some_plays(spark)
    drawn = bootstrap.resample_drives(p, 5, seed=3)
    copies = {r["sim_id"]: r["n"] for r in drawn.groupBy("sim_id").agg({"copies": "sum"}).toDF("sim_id", "n").collect()}
    assert copies == dict.fromkeys(range(1, 6), 60)
    bootstrap.bootstrap_splits(p, "passing", ["Season", "Passer_ID_Name"], 5, seed=3).collect()
    for name in ("drawn_drives", "drive_weights"):
        assert not [x for x in written[name].splitlines() if "BroadcastHashJoin" in x and "_unit" in x], name
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 10)
    again = bootstrap.resample_drives(p, 5, seed=3)
    assert "Broadcast" not in executed(again)
    assert values(again, "sim_id", "GameID", "Drive", "copies") == values(drawn, "sim_id", "GameID", "Drive", "copies")


def test_rosters_of_many_rows_are_merged(spark, monkeypatch):
    ids = [f"P-{i % 7}" for i in range(40)] + [None]
    p = plays(spark, [{"Passer_ID": i, "Receiver_ID": i, "Rusher_ID": i, "PlayType": "Pass"} for i in ids])
    rosters = frame(spark, [{"GSIS_ID": f"P-{i}", "Pos": q, "Season": 2015} for i in range(6) for q in ("QB", "WR")[:1 + i % 2]],
                    {"GSIS_ID": "string", "Pos": "string", "Season": "int"})
    small = preparation.roster_positions(p, rosters)
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 5)
    large = preparation.roster_positions(p, rosters)
    assert "Broadcast" in executed(small) and "Broadcast" not in executed(large)
    cols = ("Passer_ID", "Passer_Position", "Receiver_Position", "Rusher_Position")
    assert values(small, *cols) == values(large, *cols)


def test_plays_are_joined_once_a_role(spark):
    """Names and positions in one join give what the single steps give."""
    p = plays(spark, [
        {"PlayType": t, "Passer_ID": a, "Passer": a, "Receiver_ID": b, "Receiver": b, "Rusher_ID": c, "Rusher": c}
        for t in ("Sack", "Pass", "Run", None) for a in ("1", "2", None) for b in ("2", "3") for c in ("1", "4", None)])
    rosters = frame(spark, [{"GSIS_ID": i, "Pos": q, "Season": 2015} for i, q in
                            [("1", "QB"), ("1", "RB"), ("2", "WR"), ("4", "RB"), (None, "TE")]],
                    {"GSIS_ID": "string", "Pos": "string", "Season": "int"})
    whole = preparation.add_positions(p, rosters)
    names = preparation.sack_as_rush(preparation.id_name(preparation.fix_team_code(p)))
    single = preparation.roster_positions(names, rosters).drop("Passer_Name", "Receiver_Name", "Rusher_Name")
    assert whole.columns == single.columns
    assert values(whole, *whole.columns) == values(single, *single.columns)
    assert executed(whole).count("Join") == 3


def test_written_tables_run_compiled_methods_only(spark, monkeypatch):
    name = "spark.sql.codegen.hugeMethodLimit"
    before, seen = spark.conf.get(name), []
    monkeypatch.setattr(storage, "shared_folder", lambda s, f=storage.shared_folder: seen.append(s.conf.get(name)) or f(s))
    with storage.compiled_methods(spark):
        storage.settle(spark.range(3), "compiled")
        assert spark.conf.get(name) == "8000"
    assert spark.conf.get(name) == before and seen == ["8000"]


def test_integers_of_files_are_matched_by_no_pattern_first(spark, tmp_path):
    texts = ["7", " 8", "1.0", "2e3", "-4", "9007199254740993", "NA", ""]
    raw = spark.createDataFrame([(t,) for t in texts], "x string")
    out = readers._typed(raw, {"x": T.LongType()})
    assert [r["x"] for r in out.collect()] == [7, 8, 1, 2000, -4, 9007199254740993, None, None]
    plan = executed(out)
    assert plan.index("try_cast" if "try_cast" in plan else "coalesce") < plan.index("RLIKE")
