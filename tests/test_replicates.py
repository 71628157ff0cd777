"""Replicate weights and sums against plain Python."""

import math
from collections import Counter
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridvalue.functions import settle
from gridvalue.operators import replicates
from gridvalue.operators.bootstrap import draw_copies, number_units

from helpers import same


def draws(teams, n_sims, seed, first=1):
    """{(sim, keys, place): copies} of teams {keys: n}."""
    out = Counter()
    for keys, n in teams.items():
        for sim in range(first, first + n_sims):
            for place in range(1, n + 1):
                text = "|".join(str(x) for x in (seed, sim, *keys, place) if x is not None)
                out[sim, keys, int(md5(text.encode()).hexdigest()[:15], 16) % n + 1] += 1
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    """Teams of several slot blocks and unit ranges, replicates of several vectors."""
    monkeypatch.setattr(replicates, "CELL_DRAWS", 60)
    monkeypatch.setattr(replicates, "RANGE_COUNTS", 100)
    monkeypatch.setattr(replicates, "VECTOR_SIMS", 7)
    monkeypatch.setattr(replicates, "ROWS_PER_OUTPUT", 5)


TEAMS = {(2015, "AAA"): 150, (2015, "B"): 1, (2016, "AAA"): 23, (None, ""): 4, (None, "Ü"): 9}


def team_units(spark):
    rows = [(*keys, i) for keys, n in TEAMS.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "Season int, posteam string, x int")
    known = number_units(frame.where("Season is not null"), ["Season", "posteam"], [F.col("x")], "units")
    return known


def test_draws_equal_plain_hashes(spark, small_blocks):
    units = settle(team_units(spark), "units_here")
    got = draw_copies(units, ["Season", "posteam"], 17, seed=4, first_sim=3).join(units, replicates.UNIT)
    got = {(r["sim_id"], (r["Season"], r["posteam"]), r["_place"]): r["copies"] for r in got.collect()}
    assert got == draws({k: n for k, n in TEAMS.items() if k[0]}, 17, 4, 3)


def test_missing_keys_are_left_out_of_the_hash(spark, small_blocks):
    rows, start = [], 0
    for keys, n in TEAMS.items():
        rows += [(*keys, i + 1, n, start, start + i + 1) for i in range(n)]
        start += n
    units = spark.createDataFrame(rows, "Season int, posteam string, _place int, _size int, _start long, _unit long")
    got = {(r["sim_id"], r["_unit"]): r["copies"] for r in draw_copies(units, ["Season", "posteam"], 5).collect()}
    of = {(r[0:2], r[2]): r[5] for r in rows}
    assert got == {(sim, of[keys, place]): n for (sim, keys, place), n in draws(TEAMS, 5, 0).items()}


def test_sums_equal_repeated_rows(spark, small_blocks):
    """A split with most rows, missing splits, labels shared by rows, totals that are no number."""
    units = settle(team_units(spark), "units_here")
    weights = draw_copies(units, ["Season", "posteam"], 17, seed=1).collect()
    rows = []
    for u in units.collect():
        i = u["_unit"]
        split = None if i % 11 == 0 else ("hot" if i % 3 else f"s{i % 17}")
        x = math.nan if i == 20 else math.inf if i == 25 else i / 8
        rows.append((split, i // 2 % 40, i, x, i % 5, i))
    frame = spark.createDataFrame(rows, "split string, game int, _unit long, x double, n long, own long").drop("own")
    joined = settle(frame.join(replicates.replicate_weights(units, ["Season", "posteam"], 17, 1), "_unit"), "weighted")
    got = replicates.weighted_sums(joined.repartition(3), ["split"], ["game"], ["x", "n"], "games", "sim")
    assert got.columns == ["split", "sim", "x", "n", "games"]
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "int", "double", "bigint", "bigint"]
    expected = {}
    by_unit = {r[2]: r for r in rows}
    for w in weights:
        split, game, _, x, n, _ = by_unit[w["_unit"]]
        cell = expected.setdefault((split, w["sim_id"]), [0.0, 0, set()])
        cell[0] += x * w["copies"]
        cell[1] += n * w["copies"]
        cell[2].add(game)
    found = {(r["split"], r["sim"]): (r["x"], r["n"], r["games"]) for r in got.collect()}
    assert set(found) == set(expected) and len(found) == got.count()
    for k, (x, n, games) in expected.items():
        assert same(found[k][0], x) and found[k][1:] == (n, len(games))


def test_nothing_to_draw(spark):
    units = team_units(spark).where("false")
    assert draw_copies(units, ["Season", "posteam"], 3).count() == 0


def test_short_splits_are_summed_together(spark):
    """Few rows a split, in replicates that draw some of them; totals that are no number."""
    lists = pa.array([[0, 1]] * 40, pa.list_(pa.int16()))
    assert list(replicates._chunks(np.arange(1, 38), lists, 3)) == [(0, 36)]
    assert list(replicates._chunks(np.array([0, 30, 40]), lists, 3)) == [(0, 1), (1, 2)]
    rows = []
    for i in range(3000):
        x = math.inf if i % 50 == 7 else math.nan if i % 50 == 9 else i / 4
        weights = [i % 3, 0, (i // 2) % 2, i % 2]
        rows.append((None if i < 3 else i // 3, i // 2, 1, weights, x, i))
    schema = "split int, game int, _first_sim int, _weights array<smallint>, x double, n long"
    joined = settle(spark.createDataFrame(rows, schema), "weighted")
    got = replicates.weighted_sums(joined.repartition(2), ["split"], ["game"], ["x", "n"], "games", "sim")
    expected = {}
    for split, game, first, weights, x, n in rows:
        for sim, w in enumerate(weights, first):
            if w:
                cell = expected.setdefault((split, sim), [0.0, 0, set()])
                cell[0], cell[1] = cell[0] + x * w, cell[1] + n * w
                cell[2].add(game)
    found = {(r["split"], r["sim"]): (r["x"], r["n"], r["games"]) for r in got.collect()}
    assert set(found) == set(expected)
    assert all(same(found[k][0], x) and found[k][1:] == (n, len(g)) for k, (x, n, g) in expected.items())
