import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridvalue.functions.quantile import normal_quantile
from gridvalue.operators import reliability as rel


def test_discrimination_and_stability_by_hand(spark):
    rng = np.random.default_rng(0)
    stats = pd.DataFrame([(s, p, 100 + i, 10.0 * i + s) for s in (1, 2) for i, p in enumerate("abc")],
                         columns=["yr", "who", "n", "m"])
    stats = pd.concat([stats, pd.DataFrame([(1, "few", 3, 99.0)], columns=stats.columns)])
    boot = pd.DataFrame([(s, p, 100, 10.0 * i + s + rng.normal()) for s in (1, 2)
                         for i, p in enumerate("abc") for _ in range(4)], columns=["yr", "who", "n", "m"])
    out = rel.reliability(spark.createDataFrame(boot), spark.createDataFrame(stats), "who", "yr", "n", 50, ["m"])
    kept = stats[stats["n"] >= 50]
    bv = boot.groupby(["yr", "who"])["m"].var()
    disc = np.mean([1 - bv[s].mean() / kept[kept["yr"] == s]["m"].var() for s in (1, 2)])
    pv = kept.groupby("who")["m"].var()
    rows = kept.set_index(["yr", "who"]).index
    within = np.mean([pv[w] - bv[y, w] for y, w in rows])
    stab = 1 - within / (kept["m"].var() - bv.mean())
    row = out.first()
    assert row["Discrimination"] == pytest.approx(disc)
    assert row["Stability"] == pytest.approx(stab)


def test_one_undefined_season_hides_discrimination(spark):
    stats = spark.createDataFrame([(1, "a", 9, 1.0), (1, "b", 9, 2.0), (2, "a", 9, 1.0)],
                                  "yr int, who string, n int, m double")
    boot = stats.unionByName(stats.withColumn("m", stats["m"] + 1))
    row = rel.reliability(boot, stats, "who", "yr", "n", 1, ["m"]).first()
    assert row["Discrimination"] is None


def test_normal_quantile_equals_standard_library(spark):
    tails = [10.0 ** -k for k in range(1, 17)] + [1e-40, 1e-300]
    ps = [i / 997 for i in range(1, 997)] + tails + [1 - t for t in tails if 1 - t < 1] + [0.075, 0.925, 0.5]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")).alias("z"))
    for r in rows.collect():
        assert math.isclose(r["z"], NormalDist().inv_cdf(r["p"]), rel_tol=1e-14, abs_tol=1e-15)
    outside = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (2.0,), (None,), (math.nan,)], "p double")
    assert [r[0] for r in outside.select(normal_quantile(F.col("p"))).collect()] == [None] * 6


def test_normal_scores_use_mean_ranks(spark):
    values = spark.createDataFrame([("m", v) for v in (1.0, 2.0, 2.0, 3.0, None)], "Metric string, Value double")
    got = {r["Value"]: r["score"] for r in rel.normal_scores(values).collect()}

    z = NormalDist().inv_cdf
    assert got == pytest.approx({1.0: z(1 / 5), 2.0: z(2.5 / 5), 3.0: z(4 / 5)})


def test_independence_finds_the_redundant_metric(spark):
    rng = np.random.default_rng(1)
    n = 3000
    a, b, c = rng.normal(size=(3, n))
    pdf = pd.DataFrame({"n": 10, "a": a, "b": b, "c": c, "d": a + b + 0.1 * rng.normal(size=n)})
    names = ["a", "b", "c", "d"]
    out = rel.independence(spark.createDataFrame(pdf), "n", 1, names)
    m = rel.independence_matrix(out, names).toPandas().set_index("Metric")
    assert m.loc["c", "4"] == pytest.approx(1.0, abs=0.02)
    assert m.loc["d", "4"] < 0.05
    assert (m["1"] == 1.0).all()
    assert (m["4"] <= m["3"] + 1e-12).all() and (m["3"] <= m["2"] + 1e-12).all()
    corr = rel.copula_correlation(spark.createDataFrame(pdf), "n", 1, names)
    one = rel.cond_var(corr, names, "d", ["a", "b", "c"]).first()
    assert one["Conditional_Variance"] == pytest.approx(m.loc["d", "4"])


def test_equal_metrics_are_no_obstacle():
    import numpy as np

    from gridvalue.operators.reliability import conditional_variance, valid_correlation

    c = np.array([[1, 0.5, 0.5], [0.5, 1, 1], [0.5, 1, 1.0]])
    assert abs(conditional_variance(c, 0, [1, 2]) - 0.75) < 1e-9
    assert abs(conditional_variance(c, 1, [0, 2])) < 1e-9
    bad = valid_correlation([1, 0.9, -0.9, 0.9, 1, 0.9, -0.9, 0.9, 1])
    assert np.linalg.eigvalsh(bad).min() > -1e-9 and np.allclose(np.diag(bad), 1)
    assert valid_correlation([1, None, None, 1]).tolist() == [[1, 0], [0, 1]]


def drop_by_subsets(c, target):
    """Every subset solved anew."""
    kept, out = [j for j in range(len(c)) if j != target], []
    while kept:
        out.append(rel.conditional_variance(c, target, kept))
        losses = [rel.conditional_variance(c, target, [k for k in kept if k != j]) for j in kept]
        kept.pop(int(np.argmax(np.round(losses, 9))))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_sweeps_equal_solving_every_subset(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 8)) @ rng.normal(size=(8, 8))
    c = np.corrcoef(x.T)
    for target in range(8):
        assert rel.dropped_in_turn(c, target) == pytest.approx(drop_by_subsets(c, target), abs=1e-9)


def test_sweeps_of_dependent_metrics():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 5))
    x = np.column_stack([x, x[:, 0], x[:, 1] + x[:, 2], x[:, 3] - 2 * x[:, 4], rng.normal(size=80)])
    c = np.corrcoef(x.T)
    for target in range(len(c)):
        assert rel.dropped_in_turn(c, target) == pytest.approx(drop_by_subsets(c, target), abs=1e-7)
    assert rel.dropped_in_turn(np.eye(1), 0) == []


def test_correlation_of_pairs_with_missing_and_constant_metrics(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(300, 3)), columns=list("abc"))
    pdf["b"] += pdf["a"]
    pdf.loc[rng.random(300) < 0.3, "b"] = None
    pdf["same"], pdf["none"], pdf["n"] = 4.0, np.nan, 10
    names = ["a", "b", "c", "same", "none"]
    got = rel.copula_correlation(spark.createDataFrame(pdf), "n", 1, names).first()["matrix"]

    z = pdf[names].rank() / (pdf[names].notna().sum() + 1)
    z = z.map(lambda v: NormalDist().inv_cdf(v) if v == v else v)
    expected = z.corr()
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            r = got[i * 5 + j]
            if a == b:
                assert r == 1.0
            elif {a, b} & {"same", "none"}:
                assert r is None
            else:
                assert r == pytest.approx(expected.loc[a, b], abs=1e-12)
    empty = rel.copula_correlation(spark.createDataFrame(pdf).where("false"), "n", 1, ["a", "b"]).first()["matrix"]
    assert empty == [1.0, None, None, 1.0]
