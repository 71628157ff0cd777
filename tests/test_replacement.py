import math

from gridvalue.operators import replacement as rep
from gridvalue.operators.tables import PositionTables, SeasonTables
from helpers import frame, values

TABLE = {"Season": "int", "Player_ID_Name": "string", "Targets": "long", "Rush_Attempts": "long"}


def league(spark, attempts, targets=None):
    rows = [{"Season": 1, "Player_ID_Name": n, "Rush_Attempts": a,
             "Targets": 1 if targets is None else targets[n]} for n, a in attempts.items()]
    return frame(spark, rows, TABLE)


def names(df):
    return [r[0] for r in values(df, "Player_ID_Name")]


def test_short_league_yields_exactly_the_last(spark):
    rb = league(spark, {f"p{i}": 20 - i for i in range(10)})
    t = SeasonTables(rb=rb)
    assert names(rep.league_replacement(3, "RB", "Rush_Attempts")(t)) == ["p9"]
    assert names(rep.league_replacement(3, "RB", "Rush_Attempts", strict_depth=True)(t)) == []


def test_tie_at_cutoff_keeps_lower_name_and_ranks_rush_only_last(spark):
    rb = league(spark, {"a": 9, "b": 5, "c": 5, "d": 5}, {"a": 1, "b": 0, "c": 1, "d": 1})
    rule = rep.league_replacement(1, "RB", "Rush_Attempts", teams=2)
    assert names(rule(SeasonTables(rb=rb))) == ["b", "d"]


def test_combined_table_ranks_te_before_wr(spark):
    t = SeasonTables(te=league(spark, {"z": 5, "y": 1}), wr=league(spark, {"a": 5, "b": 1}))
    rule = rep.league_replacement(1, "WR", "Rush_Attempts", combine_wrte=True, teams=1)
    assert names(rule(t)) == ["a", "b", "y"]


def test_pooled_seasons_without_run_keys(spark):
    rb = league(spark, {f"p{i}": i for i in range(5)})
    rule = rep.league_replacement(1, "RB", "Rush_Attempts", teams=2)
    assert names(rule(SeasonTables(rb=rb, run_keys=()))) == ["p0", "p1", "p2"]


def test_share_rule_spares_traded_player_and_drops_nan(spark):
    types = {"Season": "int", "Player_ID_Name": "string", "posteam": "string", "s": "double"}
    rows = [("t", "A", 0.5), ("t", "B", 0.02), ("u", "A", 0.05), ("n", "C", math.nan), ("m", "C", None),
            ("e", "D", 0.1)]
    df = frame(spark, [dict(Season=1, Player_ID_Name=p, posteam=k, s=s) for p, k, s in rows], types)
    assert names(rep.percentage_replacement_of(df, "s", 0.1)) == ["m", "n", "u"]


PASS = {"Season": "int", "posteam": "string", "GameID": "long", "qtr": "int", "TimeSecs": "double",
        "Passer_ID_Name": "string"}


def passes(spark, rows):
    cols = list(PASS)
    return frame(spark, [dict(zip(cols, (1, *r))) for r in rows], PASS)


def test_roster_rule_counts_any_team(spark):
    rows = ([("A", 1, 1, 9.0, "x")] * 5 + [("A", 1, 1, 9.0, "t")] * 3 + [("A", 1, 1, 9.0, "s")] * 3
            + [("B", 1, 1, 9.0, "b")] * 4 + [("B", 1, 1, 9.0, "x")])
    t = SeasonTables(passing=passes(spark, rows))
    assert names(rep.roster_replacement(2, "QB", "pass")(t)) == ["s", "t", "x"]
    assert names(rep.roster_replacement(3, "QB", "pass")(t)) == ["t"]
    assert names(rep.roster_replacement(1, "QB", "pass")(t)) == ["b", "s", "t", "x"]


def test_opening_game_starter(spark):
    rows = [("A", 2, 1, 900.0, "late"), ("A", 1, 2, 900.0, "second"), ("A", 1, 1, 800.0, "third"),
            ("A", 1, 1, 850.0, "first"), ("A", 1, 1, None, "untimed"), ("B", 5, 2, 10.0, "first"),
            ("B", 5, 2, 10.0, "none"), (None, 0, 1, 999.0, "ghost")]
    t = SeasonTables(passing=passes(spark, rows))
    assert names(rep.game_one_replacement()(t)) == ["late", "none", "second", "third", "untimed"]


def test_precedence_and_reuse(spark):
    one = {"Season": 1, "posteam": "A"}
    passing = frame(spark, [{**one, "Passer_ID_Name": "q", "Receiver_ID_Name": "m"},
                            {**one, "Passer_ID_Name": "k", "Receiver_ID_Name": "w"}],
                    {"Season": "int", "posteam": "string", "Passer_ID_Name": "string", "Receiver_ID_Name": "string"})
    rushing = frame(spark, [{**one, "Rusher_ID_Name": n} for n in ("q", "m", "w")],
                    {"Season": "int", "posteam": "string", "Rusher_ID_Name": "string"})
    tables = {p: league(spark, {n: 1 for n in ns}) for p, ns in
              {"qb": ["q", "k"], "rb": ["m"], "wr": ["m", "w"], "te": ["z"]}.items()}
    t = SeasonTables(passing=passing, rushing=rushing, **tables)

    def fixed(*ns):
        df = frame(spark, [{"Season": 1, "Player_ID_Name": n} for n in ns],
                   {"Season": "int", "Player_ID_Name": "string"})
        return lambda _: df

    rules = {"QB": fixed("q"), "RB_rec": fixed("m"), "WR_rec": fixed("m", "w"), "TE_rec": fixed(),
             "RB_rush": fixed("m"), "WR_TE_rush": fixed("m", "w"), }
    out = rep.find_replacement_level(t, rules)
    assert values(out.passing, "Passer_ID_Name", "Receiver_ID_Name") == [
        ("Replacement_QB", "Replacement_RB_rec"), ("k", "Replacement_WR_rec")]
    assert values(out.rushing, "Rusher_ID_Name") == [
        ("Replacement_QB",), ("Replacement_RB_rush",), ("Replacement_WR_TE_rush",)]
    assert values(out.wr, "Player_ID_Name", "Replacement_Level_Receiver", "Player_Model_ID_Rec") == [
        ("m", 1, "Replacement_WR_rec"), ("w", 1, "Replacement_WR_rec")]
    stored = PositionTables(out.qb, out.rb, out.wr, out.te)
    again = rep.reuse_replacement_level(t, stored)
    assert values(again.rushing, "Rusher_ID_Name") == values(out.rushing, "Rusher_ID_Name")
    assert values(again.qb, "Player_ID_Name", "Replacement_Level") == [("k", 0), ("q", 1)]
