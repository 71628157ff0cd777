"""How far a metric tells players apart, stays with a player, and says something new."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee_div, null_safe_join, prefix_sum, settle
from ..functions.quantile import normal_quantile


def unpivot_stats(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide to long: (ids, Metric, Value), values as doubles."""
    wide = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(list(ids), list(metrics), "Metric", "Value")


def _enough(df: DataFrame, player: str, season: str | None, attempts: str, minimum: float,
            metrics: Sequence[str]) -> DataFrame:
    kept = df.where(F.col(attempts) >= minimum)
    ids = [F.col(player).alias("Player")]
    if season is not None:
        ids.append(F.col(season).alias("Season"))
    # NaN counts as missing, as it does in a variance that skips missing values.
    return kept.select(*ids, *[F.nanvl(F.col(m).cast("double"), F.lit(None)).alias(m) for m in metrics])


def reliability_inputs(
    boot: DataFrame, stats: DataFrame, player: str, season: str, attempts: str,
    minimum: float, metrics: Sequence[str],
) -> DataFrame:
    """One row per player-season and metric with its value and three variances."""
    values = settle(unpivot_stats(
        _enough(stats, player, season, attempts, minimum, metrics), ["Season", "Player"], metrics
    ), "metric_values")
    boots = unpivot_stats(
        _enough(boot, player, season, attempts, minimum, metrics), ["Season", "Player"], metrics
    )
    boot_var = boots.groupBy("Season", "Player", "Metric").agg(
        F.var_samp("Value").alias("Boot_Variance"))
    player_var = values.groupBy("Player", "Metric").agg(
        F.var_samp("Value").alias("Player_Variance"))
    total_var = values.groupBy("Metric").agg(F.var_samp("Value").alias("Total_Variance"))
    out = null_safe_join(values, player_var, ["Player", "Metric"])
    out = null_safe_join(out, settle(total_var, "total_variance"), ["Metric"])
    return null_safe_join(out, boot_var, ["Season", "Player", "Metric"])


def discrimination(rows: DataFrame) -> DataFrame:
    """Share of a season's spread that is not replicate noise, averaged over seasons.

    One undefined season makes the average undefined.
    """
    per_season = rows.groupBy("Season", "Metric").agg(
        (1 - ieee_div(F.avg("Boot_Variance"), F.var_samp("Value"))).alias("d")
    )
    complete = F.count("d") == F.count(F.lit(1))
    return per_season.groupBy("Metric").agg(
        F.when(complete, F.avg("d")).alias("Discrimination")
    )


def stability(rows: DataFrame) -> DataFrame:
    """Share of the total spread that stays with the player over seasons."""
    noise = F.avg("Boot_Variance")
    within = F.avg(F.col("Player_Variance") - F.col("Boot_Variance"))
    return rows.groupBy("Metric").agg(
        (1 - ieee_div(within, F.max("Total_Variance") - noise)).alias("Stability")
    )


def reliability(
    boot: DataFrame, stats: DataFrame, player: str, season: str, attempts: str,
    minimum: float, metrics: Sequence[str],
) -> DataFrame:
    """Discrimination and stability per metric."""
    rows = settle(
        reliability_inputs(boot, stats, player, season, attempts, minimum, metrics), "reliability"
    )
    return null_safe_join(discrimination(rows), stability(rows), ["Metric"])


#: Relative size below which an eigenvalue of a correlation matrix, what others leave of a
#: metric, or the variance of scores counts as 0.
RANK_TOL = 1e-10
CONSTANT = 1e-12


def normal_scores(values: DataFrame) -> DataFrame:
    """(Metric, Value, score): normal quantile of the mean rank over n + 1.

    Works on distinct values with their counts, ranked by a distributed prefix
    sum, so neither a common value nor a long metric is gathered in one task.
    """
    distinct = values.where(F.col("Value").isNotNull()).groupBy("Metric", "Value").agg(
        F.count(F.lit(1)).alias("_times"))
    ranked = settle(
        prefix_sum(distinct, ["Metric"], [F.col("Value")], F.col("_times"), "_below"), "ranks"
    )
    size = ranked.groupBy("Metric").agg(F.sum("_times").alias("_n"))
    share = (F.col("_below") + (F.col("_times") + 1) / 2) / (F.col("_n") + 1)
    joined = null_safe_join(ranked, settle(size, "metric_sizes"), ["Metric"]).withColumn("_share", share)
    return joined.select("Metric", "Value", normal_quantile(F.col("_share")).alias("score"))


def copula_correlation(
    stats: DataFrame, attempts: str, minimum: float, metrics: Sequence[str]
) -> DataFrame:
    """One row: correlations of normal scores over complete pairs, row-major in ``matrix``.

    Scores are joined once, in long form. A task adds up products of whole matrices of
    scores; what is shuffled is four numbers a pair of metrics and task. A pair in which
    one metric does not vary has no correlation.
    """
    names, p = list(metrics), len(metrics)
    wide = stats.where(F.col(attempts) >= minimum).select(
        *[F.nanvl(F.col(m).cast("double"), F.lit(None)).alias(m) for m in names]
    )
    rows = settle(wide.withColumn("_row", F.monotonically_increasing_id()), "metric_rows")
    values = unpivot_stats(rows, ["_row"], names).where(F.col("Value").isNotNull())
    scores = settle(normal_scores(values), "scores")
    place = F.from_json(F.lit(json.dumps({m: i for i, m in enumerate(names)})), "map<string,int>")
    scored = values.join(scores, ["Metric", "Value"]).groupBy("_row").agg(
        F.collect_list(F.struct(F.element_at(place, F.col("Metric")).alias("at"), "score")).alias("s"))

    def products(batches):
        sums = np.zeros((4, p, p))
        for batch in batches:
            lists = batch.column("s")
            cells = lists.flatten()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            z, there = np.zeros((len(lists), p)), np.zeros((len(lists), p))
            at = cells.field(0).to_numpy()
            z[row, at], there[row, at] = cells.field(1).to_numpy(), 1.0
            sums += there.T @ there, z.T @ there, (z * z).T @ there, z.T @ z
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(p), p)), pa.array(np.tile(np.arange(p), p)),
            *[pa.array(x.ravel()) for x in sums]], names=["i", "j", "n", "s", "q", "c"])

    kinds = "i long, j long, n double, s double, q double, c double"
    totals = scored.select("s").mapInArrow(products, kinds).groupBy("i", "j").agg(
        *[F.sum(x).alias(x) for x in ("n", "s", "q", "c")])
    totals = settle(totals, "score_products")
    other = totals.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    # Every pair, so that metrics without values have their place too.
    pairs = stats.sparkSession.range(p * p).select(F.expr(f"id div {p}").alias("i"), (F.col("id") % p).alias("j"))
    both = pairs.join(totals.join(other, ["i", "j"]), ["i", "j"], "left")

    def spread(s: str, q: str) -> Column:
        var = F.col(q) - F.try_divide(F.col(s) * F.col(s), F.col("n"))
        return F.when(var > F.lit(CONSTANT) * F.col(q), F.sqrt(var))

    cov = F.col("c") - F.try_divide(F.col("s") * F.col("s2"), F.col("n"))
    corr = F.try_divide(cov, spread("s", "q") * spread("s2", "q2"))
    cell = F.struct("i", "j", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(corr).alias("r"))
    return both.agg(F.transform(F.sort_array(F.collect_list(cell)), lambda x: x["r"]).alias("matrix"))


def conditional_variance(c: np.ndarray, target: int, given: list[int]) -> float:
    """Variance of one variable given others, from their correlation matrix.

    Equal or linearly dependent predictors count once: eigenvalues below ``RANK_TOL``
    times the largest are left out. The variance is 0 or more.
    """
    if not given:
        return float(c[target, target])
    cross = c[target, given]
    inverse = np.linalg.pinv(c[np.ix_(given, given)], rcond=RANK_TOL, hermitian=True)
    return max(float(c[target, target] - cross @ inverse @ cross), 0.0)


def valid_correlation(flat: list) -> np.ndarray:
    """The nearest matrix (by clipped eigenvalues) that is a correlation matrix.

    Pairs without a correlation, as with a constant metric, count as uncorrelated. A
    matrix that is valid already is returned unchanged.
    """
    p = round(len(flat) ** 0.5)
    c = np.nan_to_num(np.array([np.nan if x is None else x for x in flat], float).reshape(p, p))
    np.fill_diagonal(c, 1.0)
    values, axes = np.linalg.eigh(c)
    if values.min() >= -RANK_TOL:
        return c
    c = (axes * np.maximum(values, 0.0)) @ axes.T
    scale = np.sqrt(np.diag(c))
    return c / scale[:, None] / scale[None, :]


def cond_var(
    correlation: DataFrame, metrics: Sequence[str], target: str, given: Sequence[str]
) -> DataFrame:
    """Conditional variance of ``target`` given ``given`` from a copula correlation."""
    index = {m: i for i, m in enumerate(metrics)}
    picks = [index[g] for g in given]

    def per_batch(batches):
        for pdf in batches:
            for flat in pdf["matrix"]:
                c = valid_correlation(list(flat))
                value = conditional_variance(c, index[target], picks)
                yield pd.DataFrame({"Metric": [target], "Conditional_Variance": [value]})

    return correlation.mapInPandas(per_batch, "Metric string, Conditional_Variance double")


class _Sweep:
    """Variance of a target given a shrinking set of predictors.

    Holds the correlation matrix swept on independent predictors that span all that are
    kept; the rest depend on those. Dropping a predictor takes O(p^2).
    """

    def __init__(self, c: np.ndarray, target: int):
        self.a, self.target = c.copy(), target
        self.kept = [j for j in range(len(c)) if j != target]
        self.swept = np.zeros(len(c), bool)
        while self._take_in():
            pass

    @property
    def variance(self) -> float:
        return max(float(self.a[self.target, self.target]), 0.0)

    def _loose(self) -> list[int]:
        return [j for j in self.kept if not self.swept[j]]

    def _pivot(self, k: int) -> None:
        """Sweep on a predictor, or undo that."""
        row, d = self.a[k].copy(), self.a[k, k]
        self.a -= np.outer(row, row) / d
        row = -row / d if self.swept[k] else row / d
        self.a[k], self.a[:, k] = row, row
        self.a[k, k] = -1 / d
        self.swept[k] = not self.swept[k]

    def _take_in(self) -> bool:
        """Sweep on the kept predictor that the swept ones explain least, if any is left."""
        loose = self._loose()
        if not loose:
            return False
        k = max(loose, key=lambda j: self.a[j, j])
        if self.a[k, k] <= RANK_TOL:
            return False
        self._pivot(k)
        return True

    def loss(self) -> np.ndarray:
        """What the variance gains when each kept predictor goes: nothing if it depends on
        others or one of those can stand in for it."""
        out, loose = np.zeros(len(self.kept)), self._loose()
        for i, k in enumerate(self.kept):
            if self.swept[k]:
                size = -self.a[k, k]
                if not loose or (self.a[k, loose] ** 2).max() / size <= RANK_TOL:
                    out[i] = self.a[k, self.target] ** 2 / size
        return out

    def drop(self, k: int) -> None:
        self.kept.remove(k)
        if self.swept[k]:
            self._pivot(k)
            self._take_in()


def dropped_in_turn(c: np.ndarray, target: int) -> list[float]:
    """Variance of the target given all others, then without the predictor whose loss raises
    it most, and so on down to one predictor. Ties, to nine digits, go to the first."""
    sweep, out = _Sweep(c, target), []
    while sweep.kept:
        out.append(sweep.variance)
        sweep.drop(sweep.kept[int(np.argmax(sweep.loss().round(9)))])
    return out


def independence(
    stats: DataFrame, attempts: str, minimum: float, metrics: Sequence[str]
) -> DataFrame:
    """Conditional variance of each metric as its predictors are dropped.

    Returns (Metric, n_terms, Value): ``n_terms`` = number of metrics keeps all
    others as predictors; each step down removes the predictor whose loss raises
    the variance most; ``n_terms`` = 1 is 1 by definition. Each metric is solved
    in its own group, on the small metric-by-metric matrix, in O(p^3) for p metrics.
    """
    names = list(metrics)
    c = copula_correlation(stats, attempts, minimum, names)
    index = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(m).alias("Metric")) for i, m in enumerate(names)
    ])).alias("m")
    per_metric = settle(c.select("matrix", index).select("matrix", "m.*"), "correlation")

    def eliminate(pdf: pd.DataFrame) -> pd.DataFrame:
        target = int(pdf["i"].iloc[0])
        variances = dropped_in_turn(valid_correlation(list(pdf["matrix"].iloc[0])), target)
        values = {1: 1.0} | dict(zip(range(len(names), 1, -1), variances))
        return pd.DataFrame({
            "Metric": names[target], "n_terms": list(values), "Value": list(values.values())
        })

    return per_metric.groupBy("i").applyInPandas(eliminate, "Metric string, n_terms int, Value double")


def independence_matrix(long: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Wide form: one row per metric, one column per number of terms."""
    return long.groupBy("Metric").pivot("n_terms", list(range(1, len(metrics) + 1))).agg(
        F.first("Value"))
