"""Mixed models whose largest grouping factor is too large for one task.

The largest factor stays a distributed table of level rows. Eliminating it at a
relative sd ``t`` is a sum over its levels, so a search over ``t`` is a few passes
that each add up small matrices for several candidates at once; the other
factors' sds are found exactly for every candidate. The criterion is the one
:mod:`gridvalue.operators.reml` minimises, and so is the optimum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import settle
from . import reml

LEVELS_PER_BUCKET = 20_000
MAX_OTHER_LEVELS = 2_000  # levels of all factors but the largest, per run
CANDIDATES = 9
PASSES = 8
START = [0.0, *np.geomspace(1e-2, 30.0, CANDIDATES - 1)]


def _split_system(stats: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(size and largest factor per run, its level rows, the rest of the system)."""
    single = F.col("factor_a").isNotNull() & F.col("factor_b").isNull()
    counts = stats.where(single).groupBy(*keys, "factor_a").agg(F.count(F.lit(1)).alias("n"))
    runs = counts.groupBy(*keys).agg(
        F.max(F.struct("n", "factor_a")).alias("m"), F.sum("n").alias("all"))
    runs = settle(runs.select(
        *keys, F.col("m.factor_a").alias("big"), (F.col("all") - F.col("m.n")).alias("others"),
        F.ceil(F.col("m.n") / LEVELS_PER_BUCKET).cast("int").alias("buckets"),
    ), "wide_runs")
    most = runs.agg(F.max("others")).first()[0]
    if most > MAX_OTHER_LEVELS:
        raise ValueError(
            f"{most} levels outside the largest grouping factor; at most {MAX_OTHER_LEVELS} "
            "can be factored exactly. Pool rare levels first."
        )
    tagged = stats.join(runs, keys)
    on_a, on_b = F.col("factor_a") == F.col("big"), F.col("factor_b") == F.col("big")
    touches = F.coalesce(on_a | on_b, on_a, F.lit(False))
    rest = settle(tagged.where(~touches).drop("buckets", "others"), "wide_rest")

    # Position of every other level; their number per run is bounded above.
    order = Window.partitionBy(*keys).orderBy("factor_a", "level_a")
    places = settle(rest.where(single).select(
        *keys, F.col("factor_a").alias("other"), F.col("level_a").alias("other_level"),
        (F.row_number().over(order) - 1).alias("at"),
    ), "wide_places")

    mine = tagged.where(touches)
    pairs = mine.where(F.col("factor_b").isNotNull()).select(
        *keys, F.when(on_a, F.col("level_a")).otherwise(F.col("level_b")).alias("level"),
        F.when(on_a, F.col("factor_b")).otherwise(F.col("factor_a")).alias("other"),
        F.when(on_a, F.col("level_b")).otherwise(F.col("level_a")).alias("other_level"),
        F.element_at("stats", 1).alias("n"),
    )
    sparse = pairs.join(places, [*keys, "other", "other_level"]).groupBy(*keys, "level").agg(
        F.collect_list(F.struct("at", "n")).alias("cells"))
    own = mine.where(F.col("factor_b").isNull()).select(
        *keys, F.col("level_a").alias("level"), "stats", "others", "buckets")
    rows = own.join(sparse, [*keys, "level"], "left").select(
        *keys, "level", "stats", "others",
        F.expr("transform(cells, c -> c.at)").alias("at"),
        F.expr("transform(cells, c -> c.n)").alias("n"),
        F.pmod(F.xxhash64("level"), F.col("buckets")).cast("int").alias("bucket"),
    )
    return runs, settle(rows, "wide_rows"), rest


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Dense rows over [other levels, fixed terms, response], and numbers of plays."""
    xy = np.vstack(pdf["stats"].to_list()).astype(float)
    q = int(pdf["others"].iloc[0])
    out = np.zeros((len(pdf), q + xy.shape[1]))
    out[:, q:] = xy
    for i, (at, n) in enumerate(zip(pdf["at"], pdf["n"])):
        if at is not None:
            out[i, np.asarray(at, int)] = n
    return out, xy[:, 0].copy()


def _eliminate(rows: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(run, candidate, position, value): matrix removed by each candidate.

    The position after the last one holds the log-determinant.
    """
    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        b, counts = _matrix(pdf)
        parts = []
        for c, t in enumerate(pdf["ts"].iloc[0]):
            w = t * t / (t * t * counts + 1.0)
            removed = (b * w[:, None]).T @ b
            values = np.append(
                removed[np.triu_indices(len(removed))], np.log1p(t * t * counts).sum())
            parts.append(pd.DataFrame({"c": c, "pos": np.arange(len(values)), "v": values}))
        out = pd.concat(parts, ignore_index=True)
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    schema = T.StructType([rows.schema[k] for k in keys] + [
        T.StructField("c", T.IntegerType()), T.StructField("pos", T.LongType()),
        T.StructField("v", T.DoubleType())])
    joined = rows.join(candidates.select(*keys, "ts"), keys)
    sums = joined.groupBy(*keys, "bucket").applyInPandas(add_up, schema)
    return sums.groupBy(*keys, "c", "pos").agg(F.sum("v").alias("v"))


def _small_system(rest: pd.DataFrame, groups: Mapping[str, list[str]], p: int):
    """Matrix over [other levels, fixed terms, response] before elimination."""
    model, big = rest["model"].iloc[0], rest["big"].iloc[0]
    k = p + 1
    others = sorted(g for g in groups[model] if g != big)
    single = rest["factor_a"].notna() & rest["factor_b"].isna()
    ones = rest[single].sort_values(["factor_a", "level_a"])
    at, levels = {}, {g: [] for g in others}
    for i, (g, v) in enumerate(zip(ones["factor_a"], ones["level_a"])):
        at[g, v] = i
        levels[g].append(v)
    q = len(at)
    m = np.zeros((q + k, q + k))
    m[q:, q:] = reml.unpack(np.asarray(rest.loc[rest["factor_a"].isna(), "stats"].iloc[0], float), k)
    if q:
        sums = np.vstack(ones["stats"].to_list()).astype(float)
        m[:q, q:], m[q:, :q] = sums, sums.T
        m[np.arange(q), np.arange(q)] = sums[:, 0]
    for r in rest[rest["factor_b"].notna()].itertuples():
        i, j = at[r.factor_a, r.level_a], at[r.factor_b, r.level_b]
        m[i, j] = m[j, i] = r.stats[0]
    return m, [(g, levels[g]) for g in others], q


class _Run:
    """One run: its small system and the sums of the current candidates."""

    def __init__(self, rest: pd.DataFrame, sums: pd.DataFrame, groups, names):
        self.model, self.big = rest["model"].iloc[0], rest["big"].iloc[0]
        self.names = names[self.model]
        self.order = groups[self.model]
        m, self.others, self.q = _small_system(rest, groups, len(self.names))
        self.fixed, cols = reml.used_columns(m, self.q)
        self.n = m[self.q, self.q]
        self.removed = {}
        for c, part in sums.groupby("c"):
            v = part.sort_values("pos")["v"].to_numpy()
            full = reml.unpack(v[:-1], len(m))
            self.removed[int(c)] = ((m - full)[np.ix_(cols, cols)], float(v[-1]))

    def profile(self, c: int) -> reml.Profile:
        return reml.Profile(
            [len(v) for _, v in self.others], len(self.fixed), self.n, lambda _t: self.removed[c])

    def best(self, c: int, start: np.ndarray) -> tuple[float, np.ndarray]:
        profile = self.profile(c)
        if not self.others:
            return profile.criterion(0.0, np.zeros(0)), np.zeros(0)

        def goal(t):
            return profile.criterion(0.0, t)

        t = reml.drop_to_zero(goal, reml.simplex_minimum(goal, start))
        return goal(t), t


def _with_keys(out: pd.DataFrame, pdf: pd.DataFrame, keys: Sequence[str]) -> pd.DataFrame:
    for k in reversed(keys):
        out.insert(0, k, pdf[k].iloc[0])
    return out


def _two_sided(fn, last: bool):
    """A cogroup function of exactly two arguments."""
    def inner(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return fn(a, b, last)
    return inner


def solve_wide(
    stats: DataFrame, keys: list[str], groups: Mapping[str, list[str]],
    names: Mapping[str, list[str]], theta: Mapping[str, Sequence[float]], schema: T.StructType,
) -> DataFrame:
    """Fit every run of ``stats``; same result layout as the grouped solve."""
    runs, rows, rest = _split_system(stats, keys)
    key_fields = [stats.schema[k] for k in keys]
    state_schema = T.StructType(key_fields + [
        T.StructField("ts", T.ArrayType(T.DoubleType())),
        T.StructField("small", T.ArrayType(T.DoubleType()))])

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        model, big = pdf["model"].iloc[0], pdf["big"].iloc[0]
        order = groups[model]
        others = sorted(g for g in order if g != big)
        given = dict(zip(order, theta.get(model, [])))
        ts = [float(given[big])] if given else START
        small = [float(given.get(g, 0.3)) for g in others]
        return _with_keys(pd.DataFrame({"ts": [ts], "small": [small]}), pdf, keys)

    def refine(sums: pd.DataFrame, left: pd.DataFrame, last: bool) -> pd.DataFrame:
        ts = np.asarray(left["ts"].iloc[0], float)
        start_small = np.asarray(left["small"].iloc[0], float)
        if left["model"].iloc[0] in theta:
            return _with_keys(pd.DataFrame({"ts": [ts], "small": [start_small]}), left, keys)
        run = _Run(left, sums, groups, names)
        tried = [run.best(c, start_small) for c in range(len(ts))]
        i = int(np.argmin([value for value, _ in tried]))
        low, high = ts[max(i - 1, 0)], ts[min(i + 1, len(ts) - 1)]
        if i == len(ts) - 1:
            high = ts[i] * 4
        zero_is_free = ts[0] == 0.0 and tried[0][0] <= tried[i][0] + 1e-6
        if last:
            new = [0.0 if zero_is_free else float(ts[i])]
            small = tried[0][1] if zero_is_free else tried[i][1]
        else:
            new, small = list(np.linspace(low, high, CANDIDATES)), tried[i][1]
            small = np.maximum(small, 0.05)
        return _with_keys(pd.DataFrame({"ts": [new], "small": [small]}), left, keys)

    state = settle(runs.groupBy(*keys).applyInPandas(start, state_schema), "wide_state")
    passes = 1 if all(m in theta for m in groups) else PASSES
    for step in range(passes):
        sums = _eliminate(rows, state, keys)
        left = rest.join(state, keys)

        narrow = _two_sided(refine, step == passes - 1)
        state = settle(
            sums.groupBy(*keys).cogroup(left.groupBy(*keys)).applyInPandas(narrow, state_schema),
            "wide_state")

    sums = _eliminate(rows, state, keys)
    solution_schema = T.StructType(key_fields + [
        T.StructField("big", T.StringType()), T.StructField("t", T.DoubleType()),
        T.StructField("sigma", T.DoubleType()), T.StructField("cols", T.ArrayType(T.IntegerType())),
        T.StructField("coef", T.ArrayType(T.DoubleType())),
        T.StructField("cov", T.ArrayType(T.DoubleType())),
        T.StructField("result", T.ArrayType(T.StructType(
            [T.StructField(f.name, f.dataType) for f in schema if f.name not in keys])))])

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        run = _Run(b, a, groups, names)
        t_big, t_small = float(b["ts"].iloc[0][0]), np.asarray(b["small"].iloc[0], float)
        coef, var, cov = run.profile(0).solve(t_big, t_small)
        sigma = float(np.sqrt(var))
        effects, i = [], 0
        for g, levels in run.others:
            block = slice(i, i + len(levels))
            sd = sigma * np.sqrt(np.maximum(np.diag(cov)[block], 0))
            effects.append((g, levels, coef[block], sd))
            i += len(levels)
        t_of = {run.big: t_big, **{g: t for (g, _), t in zip(run.others, t_small)}}
        table = reml.result_rows(
            effects, [(run.names[j], coef[run.q + n]) for n, j in enumerate(run.fixed)],
            [(g, t_of[g] * sigma) for g in run.order] + [("Residual", sigma)])
        table = table.astype(object).where(table.notna(), None)
        cols = [*range(run.q), *[run.q + j for j in run.fixed]]
        return _with_keys(pd.DataFrame({
            "big": [run.big], "t": [t_big], "sigma": [sigma], "cols": [cols],
            "coef": [coef.tolist()], "cov": [cov.ravel().tolist()],
            "result": [table.to_dict("records")],
        }), b, keys)

    left = rest.join(state, keys)
    solved = settle(
        sums.groupBy(*keys).cogroup(left.groupBy(*keys)).applyInPandas(solve, solution_schema),
        "wide_solution")

    def back(pdf: pd.DataFrame, sol: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[f.name for f in schema])
        s = sol.iloc[0]
        b, counts = _matrix(pdf)
        q = int(pdf["others"].iloc[0])
        t2 = s["t"] ** 2
        shrink = t2 / (t2 * counts + 1.0)
        est = shrink * (b[:, -1] - b[:, np.asarray(s["cols"], int)] @ np.asarray(s["coef"], float))
        cov = np.asarray(s["cov"], float).reshape(q, q)
        spread = shrink + shrink**2 * np.einsum("ij,jk,ik->i", b[:, :q], cov, b[:, :q])
        return _with_keys(pd.DataFrame({
            "kind": "effect", "factor": s["big"], "level": pdf["level"], "estimate": est,
            "sd": s["sigma"] * np.sqrt(spread),
        }), pdf, keys)

    # One copy of the solution per bucket of level rows.
    per_bucket = solved.drop("result").join(runs.select(*keys, "buckets"), keys).withColumn(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    by = [*keys, "bucket"]
    large = rows.groupBy(*by).cogroup(per_bucket.groupBy(*by)).applyInPandas(back, schema)
    small = solved.select(*keys, F.explode("result").alias("r")).select(*keys, "r.*")
    return large.unionByName(small)
