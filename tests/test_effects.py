import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridvalue.operators import reml
from gridvalue.operators.effects import MixedSpec, crossed_effects, effects_of
from helpers import assert_same_rows

SPEC = MixedSpec("y", ("x",), {"kind": "u"}, (("x", "kind"),), ("a", "b"))


def data(spark, n=500, seed=3, sd_b=0.6, seasons=(1, 2)):
    parts = []
    for s in seasons:
        rng = np.random.default_rng(seed + s)
        a, b = rng.integers(0, 40, n), rng.integers(0, 7, n)
        x, kind = rng.normal(size=n), rng.choice(["t", "u", "v"], n)
        y = (1 + 2 * x + (kind == "t") + rng.normal(size=40)[a] + sd_b * rng.normal(size=7)[b]
             + rng.normal(size=n))
        parts.append(pd.DataFrame({"Season": s, "x": x, "kind": kind, "y": y,
                                   "a": [f"a{i:02d}" for i in a], "b": [f"b{i}" for i in b]}))
    pdf = pd.concat(parts)
    return pdf, spark.createDataFrame(pdf)


def dense(pdf, sds):
    """REML criterion, fixed effects and predictions by dense algebra."""
    x, kind = pdf["x"].to_numpy(), pdf["kind"]
    t, v = (kind == "t").to_numpy(float), (kind == "v").to_numpy(float)
    X = np.c_[np.ones(len(pdf)), x, t, v, x * t, x * v]
    y, blocks, V = pdf["y"].to_numpy(), {}, sds["Residual"] ** 2 * np.eye(len(pdf))
    for g in ("a", "b"):
        z = pd.get_dummies(pdf[g]).astype(float)
        blocks[g] = z
        V += sds[g] ** 2 * z.to_numpy() @ z.to_numpy().T
    Vi = np.linalg.inv(V)
    A = X.T @ Vi @ X
    beta = np.linalg.solve(A, X.T @ Vi @ y)
    r = y - X @ beta
    d = np.linalg.slogdet(V)[1] + np.linalg.slogdet(A)[1] + r @ Vi @ r
    u = {g: pd.Series(sds[g] ** 2 * z.to_numpy().T @ Vi @ r, z.columns) for g, z in blocks.items()}
    return d, beta, u


def test_fit_matches_dense_algebra_and_is_a_minimum(spark):
    pdf, df = data(spark)
    out = crossed_effects({"m": (df, SPEC)}).toPandas()
    for season, part in out.groupby("Season"):
        own = pdf[pdf["Season"] == season]
        sds = part[part["kind"] == "sd"].set_index("factor")["estimate"].to_dict()
        d, beta, u = dense(own, sds)
        fixed = part[part["kind"] == "fixed"]["estimate"].to_numpy()
        assert np.allclose(fixed, beta, atol=1e-8)
        for g in ("a", "b"):
            got = part[(part["kind"] == "effect") & (part["factor"] == g)].set_index("level")["estimate"]
            assert np.allclose(got.sort_index(), u[g].sort_index(), atol=1e-8)
        for name in sds:
            for step in (0.97, 1.03):
                assert dense(own, {**sds, name: sds[name] * step})[0] > d


def test_balanced_one_way_shrinkage(spark):
    means = {"p": 1.0, "q": 3.0, "r": 5.0, "s": 7.0}
    rows = [(1, g, m + e) for g, m in means.items() for e in (-1.0, -0.5, 0.0, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "Season int, g string, y double")
    fits = crossed_effects({"m": (df, MixedSpec("y", groups=("g",)))})
    within = 4 * 2.5 / 16
    between = np.var(list(means.values()), ddof=1) - within / 5
    shrink = 5 / (5 + within / between)
    got = {r["level"]: r["estimate"] for r in effects_of(fits, "m", "g").collect()}
    for g, m in means.items():
        assert got[g] == pytest.approx(shrink * (m - 4.0), abs=1e-5)
    sd = {r["factor"]: r["estimate"] for r in fits.where("kind = 'sd'").collect()}
    assert sd["g"] == pytest.approx(np.sqrt(between), rel=1e-4)
    assert sd["Residual"] == pytest.approx(np.sqrt(within), rel=1e-5)
    cond = effects_of(fits, "m", "g").first()["sd"]
    assert cond == pytest.approx(np.sqrt(within * between / (within + 5 * between)), rel=1e-4)


def test_boundary_variance_is_exactly_zero(spark):
    rows = [(1, g, h, e) for g in "pqr" for h in "xyz" for e in (-1.0, 1.0)]
    df = spark.createDataFrame(rows, "Season int, g string, h string, y double")
    fits = crossed_effects({"m": (df, MixedSpec("y", groups=("g", "h")))})
    got = [r["estimate"] for r in fits.where("kind = 'effect' or (kind = 'sd' and factor <> 'Residual')").collect()]
    assert got and set(got) == {0.0}


def test_single_level_group_and_unused_terms(spark):
    pdf, df = data(spark, seasons=(1,))
    flat = df.withColumn("b", F.lit("only")).withColumn("zero", F.lit(0.0))
    spec = MixedSpec("y", ("x", "zero"), groups=("a", "b"))
    out = crossed_effects({"m": (flat, spec)}).toPandas()
    assert set(out[out["kind"] == "fixed"]["level"]) == {"(Intercept)", "x"}
    assert np.isfinite(out[out["kind"] == "effect"]["estimate"]).all()


def test_missing_rows_are_left_out(spark):
    _, df = data(spark, seasons=(1,))
    holes = df.unionByName(df.limit(20).withColumn("x", F.lit(None).cast("double")))
    a = crossed_effects({"m": (df, SPEC)})
    b = crossed_effects({"m": (holes, SPEC)})
    assert_same_rows(a, b, 1e-6)


def test_weights_equal_repeated_rows(spark):
    _, df = data(spark, n=200, seasons=(1,))
    w = df.withColumn("copies", (F.abs(F.hash("x")) % 3 + 1).cast("int"))
    repeated = w.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("i", "copies")
    a = crossed_effects({"m": (w, SPEC)}, weight="copies")
    b = crossed_effects({"m": (repeated, SPEC)})
    assert_same_rows(a, b, 1e-5)


def test_distributed_solve_equals_grouped_solve(spark, monkeypatch):
    from gridvalue.operators import wide_effects

    monkeypatch.setattr(wide_effects, "LEVELS_PER_BUCKET", 15)
    _, df = data(spark)
    a = crossed_effects({"m": (df, SPEC)})
    b = crossed_effects({"m": (df, SPEC)}, max_grouped_levels=20)
    assert_same_rows(a, b, 2e-4)
    given = {"m": [0.8, 0.3]}
    a = crossed_effects({"m": (df, SPEC)}, theta=given)
    b = crossed_effects({"m": (df, SPEC)}, theta=given, max_grouped_levels=20)
    assert_same_rows(a, b, 1e-9)


def test_factor_with_too_many_values_is_refused(spark):
    df = spark.range(500).selectExpr("1 as Season", "cast(id as string) as f", "double(id) as y",
                                     "cast(id % 3 as string) as g")
    with pytest.raises(ValueError, match="too many values"):
        crossed_effects({"m": (df, MixedSpec("y", factors={"f": None}, groups=("g",)))})


def random_system(seed, n=400, levels=(40, 12, 5)):
    """Cross products of a random crossed model, two fixed terms, three factors."""
    rng = np.random.default_rng(seed)
    ids = [rng.integers(0, k, n) for k in levels]
    x = rng.normal(size=n)
    y = 1 + x + sum(s * rng.normal(size=k)[i] for k, i, s in zip(levels, ids, (0.8, 0.0, 0.4))) + rng.normal(size=n)
    z = [np.eye(k)[i] for k, i in zip(levels, ids)]
    rest = np.column_stack([z[1], z[2], np.ones(n), x, y])
    return reml.System(n, rest.T @ rest, [("b", list(map(str, range(levels[1])))), ("c", list(map(str, range(levels[2]))))], 2,
                       "a", list(map(str, range(levels[0]))), z[0].T @ rest, z[0].sum(axis=0), ["a", "b", "c"])


def profile_of(system):
    def eliminate(t):
        w = t * t / (t * t * system.big_n + 1)
        return system.small - (system.big_rows * w[:, None]).T @ system.big_rows, float(np.log1p(t * t * system.big_n).sum())

    return reml.Profile([len(v) for _, v in system.small_groups], system.p, system.n, eliminate)


@pytest.mark.parametrize("t", [(0.5, 0.3, 0.2), (0.0, 0.4, 0.1), (0.7, 0.0, 0.0)])
def test_slopes_equal_differences_of_the_criterion(t):
    system = random_system(1)
    profile, v = profile_of(system), np.square(t)
    value, big, small = profile.slopes(t[0], np.array(t[1:]), system.big_rows, system.big_n)

    def at(v):
        t = np.sqrt(v)
        return profile.criterion(t[0], t[1:])

    assert value == pytest.approx(at(v), rel=1e-12)
    for i, slope in enumerate([big, *small]):
        h = 1e-5 * np.eye(3)[i]
        # One-sided where the variance is 0: the second-order formula from v, v + h, v + 2 h.
        numeric = (4 * at(v + h) - at(v + 2 * h) - 3 * at(v)) / 2e-5
        assert slope == pytest.approx(numeric, rel=1e-3, abs=1e-3)


@pytest.mark.parametrize("seed", range(6))
def test_slope_search_is_no_worse_than_the_simplex(seed):
    system = random_system(seed)
    fitted = reml.fit(system, ["(Intercept)", "x"])
    sd = fitted[fitted["kind"] == "sd"].set_index("factor")["estimate"]
    t = (sd[["a", "b", "c"]] / sd["Residual"]).to_numpy()
    profile = profile_of(system)
    simplex = reml.drop_to_zero(lambda t: profile.criterion(t[0], t[1:]), reml.simplex_minimum(
        lambda t: profile.criterion(t[0], t[1:]), np.full(3, 0.3)))
    assert profile.criterion(t[0], t[1:]) <= profile.criterion(simplex[0], simplex[1:]) + 1e-9
    assert t == pytest.approx(simplex, abs=1e-4)
    _, big, small = profile.slopes(t[0], t[1:], system.big_rows, system.big_n)
    slopes = np.array([big, *small])
    assert (np.abs(2 * t * slopes) < 1e-5).all() and (slopes[t == 0] > -1e-5).all()


def test_search_leaves_zero_where_the_criterion_falls():
    system = random_system(3)
    profile = profile_of(system)

    def slopes(t):
        value, big, small = profile.slopes(t[0], t[1:], system.big_rows, system.big_n)
        return value, np.array([big, *small])

    def goal(t):
        return profile.criterion(t[0], t[1:])

    a = reml.slope_minimum(goal, slopes, np.full(3, 0.3))
    b = reml.slope_minimum(goal, slopes, np.zeros(3))
    assert a == pytest.approx(b, abs=1e-6) and a[0] > 0
