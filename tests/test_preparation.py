from gridvalue.operators import preparation as prep
from gridvalue.operators.standings import points_per_win, season_summary, team_games
from helpers import frame, plays, values


def test_common_name_ties_and_missing(spark):
    names = ["b", "a", "b", "a", "c", None]
    df = plays(spark, [{"Passer_ID": "1", "Passer": n} for n in names] + [{"Passer_ID": "2"}]
               + [{"Passer_ID": None, "Passer": "z"}])
    out = prep.common_name(df, "Passer_ID", "Passer")
    assert values(out, "Passer_ID", "Name") == [("1", "a"), ("2", "None"), (None, "z")]


def test_labels_of_missing_names_and_ids(spark):
    df = plays(spark, [{"Passer_ID": "1"}, {"Passer_ID": None, "Passer": None}])
    out = prep.id_name(df)
    assert values(out, "Passer_ID_Name") == [("None-1",), ("None-NA",)]


def test_sack_makes_passer_the_rusher(spark):
    df = plays(spark, [
        {"PlayType": "Sack", "Passer_ID": "q", "Passer": "Q", "Rusher_ID": "None"},
        {"PlayType": "Run", "Passer_ID": "None", "Rusher_ID": "r", "Rusher": "R"},
        {"PlayType": None, "Passer_ID": "q", "Passer": "Q", "Rusher_ID": "r", "Rusher": "R"},
    ])
    out = prep.sack_as_rush(prep.id_name(df))
    assert values(out, "PlayType", "Rusher_ID", "Rusher_ID_Name") == [
        ("Run", "r", "R-r"), ("Sack", "q", "Q-q"), (None, None, None)]


def test_two_positions_double_plays(spark):
    df = plays(spark, [{"PlayType": "Pass", "Passer_ID": "q", "Receiver_ID": "p", "Rusher_ID": "None"}])
    rosters = frame(spark, [{"GSIS_ID": "p", "Pos": "RB"}, {"GSIS_ID": "p", "Pos": "WR"},
                            {"GSIS_ID": "q", "Pos": "QB"}, {"GSIS_ID": "q", "Pos": "QB"}],
                    {"GSIS_ID": "string", "Pos": "string"})
    out = prep.add_positions(df, rosters)
    assert values(out, "Receiver_Position", "Passer_Position") == [("RB", "QB"), ("WR", "QB")]
    first = prep.add_positions(df, rosters, on_multi_position="first")
    assert values(first, "Receiver_Position") == [("RB",)]


def test_team_code_changes_offence_and_defence_only(spark):
    df = plays(spark, [{"Season": 2016, "posteam": "JAC", "DefensiveTeam": "JAC", "HomeTeam": "JAC"},
                       {"Season": 2015, "posteam": "JAC", "DefensiveTeam": "X", "HomeTeam": "JAC"}])
    out = prep.add_model_variables(prep.fix_team_code(df))
    assert values(out, "Season", "posteam", "DefensiveTeam", "Home_Ind") == [
        (2015, "JAC", "X", 1), (2016, "JAX", "JAX", 0)]


def test_model_variables(spark):
    df = plays(spark, [
        {"desc": "(No Huddle, Shotgun) pass", "Reception": 1, "airEPA": 2.0, "EPA": 5.0, "yacEPA": 3.0,
         "posteam": "A", "HomeTeam": "A", "RunLocation": "middle", "RunGap": "end"},
        {"desc": None, "Reception": 0, "airEPA": 2.0, "EPA": 5.0, "yacEPA": 3.0, "RunGap": "end"},
        {"Reception": None, "airEPA": 2.0, "EPA": 5.0, "posteam": "A", "HomeTeam": "B",
         "RunLocation": "left", "RunGap": "end"},
    ])
    cols = ("Shotgun_Ind", "No_Huddle_Ind", "Home_Ind", "airEPA_Result", "yacEPA_Result", "Team_Side_Gap")
    assert values(prep.add_model_variables(df), *cols) == sorted([
        (1, 1, 1, 2.0, 3.0, "A-middle-center"), (0, 0, None, 5.0, 5.0, "NA-NA-NA"),
        (0, 0, 0, None, None, "A-left-end")], key=repr)


def test_team_rates_of_one_sided_team(spark):
    types = {"Season": "int", "posteam": "string", "EPA": "double", "WPA": "double"}
    passing = frame(spark, [{"Season": 1, "posteam": "A", "EPA": 1.0, "WPA": 0.5},
                            {"Season": 1, "posteam": None, "EPA": None, "WPA": 0.5}], types)
    rushing = frame(spark, [{"Season": 1, "posteam": "A", "EPA": 3.0, "WPA": 0.0},
                            {"Season": 1, "posteam": "B", "EPA": 3.0, "WPA": 0.0}], types)
    out = prep.team_rates(passing, rushing)
    assert values(out, "posteam", "Pass_EPA_Att", "Rush_EPA_Att", "Pass_Attempts") == sorted([
        ("A", 1.0, 3.0, 1), ("B", None, 3.0, None), (None, 0.0, None, 1)], key=repr)
    joined = prep.with_team_rates(passing, rushing).passing
    assert values(joined, "posteam", "Pass_EPA_Att") == [("A", 1.0), (None, 0.0)]


GAMES = {"GameID": "long", "Season": "int", "home": "string", "away": "string",
         "homescore": "int", "awayscore": "int"}


def test_ties_win_nothing_and_strict_sums(spark):
    games = frame(spark, [
        {"GameID": 1, "Season": 1, "home": "A", "away": "B", "homescore": 20, "awayscore": 20},
        {"GameID": 2, "Season": 1, "home": "A", "away": "B", "homescore": 10, "awayscore": 3},
        {"GameID": 3, "Season": 2, "home": "A", "away": "B", "homescore": None, "awayscore": 3},
        {"GameID": 4, "Season": 2016, "home": "JAC", "away": "B", "homescore": 9, "awayscore": 3},
    ], GAMES)
    assert team_games(games).where("GameID = 1 and Win_Ind = 0").count() == 2
    assert values(season_summary(games), "Season", "Team", "Wins", "Total_Score_Diff") == sorted([
        (1, "A", 1, 7), (1, "B", 0, -7), (2, "A", None, None), (2, "B", None, None),
        (2016, "B", 0, -6), (2016, "JAX", 1, 6)], key=repr)
    assert points_per_win(games).first()[0] > 0


def test_positions_follow_the_season(spark):
    df = plays(spark, [{"Season": 2015, "PlayType": "Pass", "Receiver_ID": "r", "Receiver": "R"},
                       {"Season": 2016, "PlayType": "Pass", "Receiver_ID": "r", "Receiver": "R"}])
    rosters = spark.createDataFrame([("r", "WR", 2015), ("r", "TE", 2016)], "GSIS_ID string, Pos string, Season int")
    out = prep.add_positions(df, rosters)
    assert values(out, "Season", "Receiver_Position") == [(2015, "WR"), (2016, "TE")]


def test_readers_keep_ids_and_miss_no_column(spark, tmp_path):
    import pytest

    from gridvalue.sources import load_games, load_rosters

    for year, pos in ((2015, "WR"), (2016, "TE")):
        (tmp_path / f"r{year}.csv").write_text(f"GSIS_ID,Pos\nr,{pos}\n")
    (tmp_path / "g2015.csv").write_text(
        "GameID,Season,home,away,homescore,awayscore\n9007199254740993,2015,A,B,1,2\n9007199254740992,2015,A,B,3.0,NA\n")
    (tmp_path / "h2015.csv").write_text("GameID,Season\n1,2015\n")
    assert values(load_rosters(spark, f"{tmp_path}/r{{year}}.csv", [2015, 2016]), "Pos", "Season") == [("TE", 2016), ("WR", 2015)]
    games = load_games(spark, f"{tmp_path}/g{{year}}.csv", [2015])
    assert values(games, "GameID", "homescore", "awayscore") == [(9007199254740992, 3, None), (9007199254740993, 1, 2)]
    with pytest.raises(ValueError, match="homescore"):
        load_games(spark, f"{tmp_path}/h{{year}}.csv", [2015])
