"""Places in groups, and plays drawn one by one, without shuffling rows again."""

from pyspark.sql import functions as F

from gridvalue.functions import number_rows
from gridvalue.operators import bootstrap

from helpers import plays


def test_numbering_shuffles_rows_once(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 == 0, "b").alias("g"), (3000 - F.col("id")).alias("v"))
    numbered = number_rows(df.repartition(7), ["g"], [F.col("v")], "n")
    assert "hashpartitioning" not in numbered._jdf.queryExecution().executedPlan().toString()
    rows = numbered.collect()
    for g, n in (("hot", 2700), ("b", 150), (None, 150)):
        mine = sorted((r["n"], r["v"]) for r in rows if r["g"] == g)
        assert [x for x, _ in mine] == list(range(1, n + 1))
        assert [v for _, v in mine] == sorted(v for _, v in mine)


def test_drawn_plays_equal_weights_of_units(spark, monkeypatch):
    p = plays(spark, [{"GameID": i, "posteam": "AB"[i % 2], "PlayType": "Pass"} for i in range(40)])
    units = bootstrap.play_units(p, order_by=["GameID"]).cache()
    copies = bootstrap.draw_copies(units, ["Season", "posteam"], 6, 3).join(units, bootstrap.UNIT)
    expected = sorted((r["sim_id"], r["GameID"], r["copies"]) for r in copies.collect())
    written, settle = [], bootstrap.settle
    monkeypatch.setattr(bootstrap, "settle", lambda df, name, keep=False: written.append(name) or settle(df, name, keep))
    out = bootstrap.resample_plays(p, 6, seed=3, units=units)
    assert sorted((r["sim_id"], r["GameID"], r["copies"]) for r in out.collect()) == expected
    assert out.columns == [*[c for c in units.columns if not c.startswith("_")], "sim_id", "copies"]
    assert "drawn_plays" not in written
