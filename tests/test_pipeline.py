import pytest
from pyspark.sql import functions as F

from gridvalue import registry
from gridvalue.operators import bootstrap as boot
from gridvalue.operators import positions, preparation, replacement, splits, value
from gridvalue.plans import season
from gridvalue.sources import load_plays, read_season, write_season
from helpers import assert_same_rows, plays, values


@pytest.fixture(scope="module")
def tables(spark, sf):
    return registry.tables(spark, sf)


def test_measure_counts(tables):
    assert len(splits.passing_splits(tables.passing).columns) == 1 + 86
    assert len(splits.receiving_splits(tables.passing).columns) == 1 + 81
    assert len(splits.rushing_splits(tables.rushing).columns) == 1 + 26


def test_touchdown_rate_quirk_can_be_switched_off(tables):
    a = splits.passing_splits(tables.passing, ["Season"]).first()
    b = splits.passing_splits(tables.passing, ["Season"], faithful=False).first()
    assert a["TD_per_Att"] == a["Air_TD_per_Att"] == a["Air_TDs"] / a["Pass_Attempts"]
    assert b["TD_per_Att"] == b["Pass_TDs"] / b["Pass_Attempts"]


def test_split_key_may_share_a_measure_name(tables):
    named = tables.passing.withColumn("Pass_EPA", F.lit(1.0))
    out = splits.passing_splits(named, ["Season", "Pass_Attempts"])
    assert out.columns.count("Pass_Attempts") == 2


def test_strict_sack_count(spark):
    rows = [{"Rusher_ID_Name": "q", "Sack": s} for s in (1, None)]
    rushing = plays(spark, rows, Rusher_ID_Name="string", Rusher_Position="string")
    rushing = rushing.withColumn("Rusher_Position", F.lit("QB"))
    passing = plays(spark, [], Passer_ID_Name="string", Receiver_ID_Name="string",
                    Receiver_Position="string")
    t = positions.SeasonTables(passing=passing, rushing=rushing)
    row = positions.qb_table(t).first()
    assert (row["Sacks"], row["Rush_Attempts"], row["Total_Plays"]) == (0, 0, 0)


def test_shares_add_up(tables):
    out = positions.qb_team_table(tables).groupBy("Season", "posteam").agg(
        F.sum("Perc_Total_Plays").alias("s"))
    assert out.where("abs(s - 1) > 1e-9").count() == 0


def test_value_invariants(spark, sf):
    t = value.above_replacement(value.add_value(registry.pooled(spark, sf), registry.season_fits(spark, sf)))
    for position, table in t.positions().items():
        parts = F.col("air_iPAR") + F.col("yac_iPAR") + F.col("rush_iPAR")
        assert table.where(F.abs(F.col("total_iPAR") - parts) > 1e-12).count() == 0
        flag, facet = ("Replacement_Level", "air") if position == "QB" else ("Replacement_Level_Receiver", "air")
        level = table.where(F.col(flag) == 1)
        assert level.count() > 0
        assert level.where(F.abs(F.col(f"{facet}_iPAR")) > 1e-12).count() == 0


def test_no_replacement_player_leaves_value_missing(spark, sf):
    t = value.add_value(registry.pooled(spark, sf), registry.season_fits(spark, sf))
    kept = t.with_positions({"QB": t.qb.where("Replacement_Level = 0")})
    assert value.above_replacement(kept).qb.where("air_iPAR is not null").count() == 0


def test_relabelling_first_zeroes_statistics(tables):
    first = positions.join_position_statistics(replacement.find_replacement_level(tables)).qb
    hit = first.where("Replacement_Level = 1")
    assert hit.count() > 0 and hit.where("Pass_Yards_Gained <> 0 or Pass_Drives <> 0").count() == 0
    last = replacement.find_replacement_level(positions.join_position_statistics(tables)).qb
    assert last.where("Replacement_Level = 1 and Pass_Attempts > 0 and Pass_Drives = 0").count() == 0


def test_intervals_from_draws_approach_the_conditional_sd(spark, sf):
    t = value.add_value(registry.pooled(spark, sf), registry.season_fits(spark, sf))
    a = value.effect_intervals(t).qb.select("Season", "Player_ID_Name", F.col("Sim_air_iPA_SD").alias("a"))
    b = value.effect_intervals(t, n_draws=400).qb.select(
        "Season", "Player_ID_Name", F.col("Sim_air_iPA_SD").alias("b"))
    both = a.join(b, ["Season", "Player_ID_Name"])
    assert both.where("a > 0").count() > 0
    assert both.where("abs(b - a) > 0.25 * a + 1e-9").count() == 0


def test_replicates_keep_the_number_of_units(spark, sf):
    plays_ = registry.model_plays(spark, sf)
    units = boot.drive_units(plays_)
    copies = boot.draw_copies(units, ["Season", "posteam"], 5, seed=1)
    drawn = copies.join(units, boot.UNIT).groupBy("Season", "posteam", "sim_id").agg(
        F.sum("copies").alias("n"))
    size = units.groupBy("Season", "posteam").agg(F.count(F.lit(1)).alias("m"))
    assert drawn.join(size, ["Season", "posteam"]).where("n <> m").count() == 0
    assert drawn.select("sim_id").distinct().count() == 5


def test_draws_do_not_depend_on_partitioning(spark, sf):
    plays_ = registry.model_plays(spark, sf)
    cols = ["Season", "posteam", "GameID", "Drive", "sim_id", "copies"]
    a = boot.resample_drives(plays_, 2, seed=5).select(cols)
    b = boot.resample_drives(plays_.repartition(13), 2, seed=5).select(cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_weighted_tables_equal_expanded_tables(spark, sf):
    drawn = boot.resample_drives(registry.model_plays(spark, sf), 2, seed=5)
    keys = ("Season", "sim_id")
    w = season.season_tables(drawn, keys, "copies")
    e = season.season_tables(boot.expand_copies(drawn), keys)
    for p in ("QB", "RB"):
        assert_same_rows(w.positions()[p], e.positions()[p])
    by = ["Season", "sim_id", "Receiver_ID_Name"]
    assert_same_rows(splits.receiving_splits(w.passing, by, "copies"),
                     splits.receiving_splits(e.passing, by))
    rates = ["Season", "sim_id", "posteam", "Pass_EPA_Att", "Rush_WPA_Att"]
    assert_same_rows(w.passing.select(rates).distinct(), e.passing.select(rates).distinct())


def test_drive_totals_give_the_same_replicates(spark, sf):
    plays_ = registry.model_plays(spark, sf)
    fast = boot.bootstrap_splits(preparation.pass_plays(plays_), "passing",
                                 ["Season", "Passer_ID_Name"], 2, seed=5, units=boot.drive_units(plays_))
    drawn = preparation.pass_plays(boot.resample_drives(plays_, 2, seed=5))
    slow = splits.passing_splits(drawn, ["Season", "Passer_ID_Name", "sim_id"], "copies")
    assert_same_rows(fast, slow)


def test_reading_season_files(spark, tmp_path):
    head = "Season,GameID,Drive,posteam,PlayType,Yards.Gained,Reception,Passer_ID,EPA\n"
    (tmp_path / "pbp_2015.csv").write_text(head + '2015,7,1,"",Pass,12,1.0,NA,0.5\n2015,7,NA,A,Run,-3,,"None",\n')
    (tmp_path / "pbp_2016.csv").write_text(head + "2016,8,2,B,Sack,-7,0,q,-1e-3\n")
    out = load_plays(spark, str(tmp_path / "pbp_{year}.csv"), [2015, 2016])
    cols = ("Season", "GameID", "Drive", "posteam", "Yards_Gained", "Reception", "Passer_ID", "EPA")
    assert values(out, *cols) == sorted([
        (2015, 7, 1, None, 12.0, 1, None, 0.5), (2015, 7, None, "A", -3.0, None, "None", None),
        (2016, 8, 2, "B", -7.0, 0, "q", -0.001)], key=repr)


def test_storing_and_reading_a_season(spark, sf, tmp_path):
    t = registry.pooled(spark, sf)
    write_season(t, str(tmp_path / "s"))
    back = read_season(spark, str(tmp_path / "s"), years=[1996])
    assert back.qb.select("Season").distinct().count() == 1
    assert back.wr.count() == t.wr.where("Season = 1996").count() > 0


def test_bootstrap_of_the_season(spark, sf):
    plays_ = registry.model_plays(spark, sf)
    stored = registry._stored(registry.pooled(spark, sf))
    out = season.bootstrap_wins(plays_, stored, 2, seed=3, sims_per_batch=1, statistics_first=True)
    assert out.qb.select("sim_id").distinct().count() == 2
    hit = out.qb.where("Replacement_Level = 1 and Pass_Attempts > 0")
    assert hit.count() > 0 and hit.where("Pass_Drives = 0").count() == 0


def test_replicates_are_written_one_row_a_play(spark, sf, monkeypatch):
    """Frames of a packed batch equal those of plays repeated per replicate."""
    written, settle_ = {}, season.settle
    monkeypatch.setattr(season, "settle", lambda df, name, **more: written.setdefault(name, settle_(df, name, **more)))
    plays_, keys = registry.model_plays(spark, sf), ("Season", boot.SIM)
    packed = season.season_tables(boot.drawn_drives(plays_, 3, seed=5), keys, boot.COPIES)
    assert written["passing"].count() <= preparation.pass_plays(plays_).count()
    written.clear()
    each = season.season_tables(boot.resample_drives(plays_, 3, seed=5), keys, boot.COPIES)
    for a, b in ((packed.passing, each.passing), (packed.rushing, each.rushing), (packed.qb, each.qb)):
        assert a.columns == b.columns and a.dtypes == b.dtypes
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
