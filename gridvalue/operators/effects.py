"""Crossed random-intercept models fitted by REML.

Spark reduces the plays to sufficient statistics: sums of products of the fixed
covariates, sums per group level and counts per pair of levels. What is left per
run does not grow with the plays, and the largest grouping factor is eliminated
in closed form before the small remaining system is solved.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import PLAYS_CODEC, settle, union_all
from . import reml

MAX_FACTOR_VALUES = 200  # a fixed factor with more values is a grouping factor


@dataclass(frozen=True)
class MixedSpec:
    """Declarative mixed model: response ~ fixed terms + random intercepts.

    ``factors`` maps a text covariate to its reference value (None = first in
    byte order); ``interactions`` pairs a numeric covariate with a factor.
    """

    response: str
    numeric: tuple[str, ...] = ()
    factors: Mapping[str, str | None] = field(default_factory=dict)
    interactions: tuple[tuple[str, str], ...] = ()
    groups: tuple[str, ...] = ()

    def columns(self) -> list[str]:
        return [self.response, *self.numeric, *self.factors, *self.groups]


@dataclass(frozen=True)
class _Design:
    names: list[str]
    columns: list[Column]


def _situation(*more: str) -> tuple[str, ...]:
    return ("Home_Ind", "Shotgun_Ind", "No_Huddle_Ind", *more)


def _model_set(measure: str, air: str, yac: str) -> dict[str, MixedSpec]:
    pass_groups = ("Passer_ID_Name", "Receiver_ID_Name", "DefensiveTeam")
    places = {"Receiver_Position": "WR", "PassLocation": None}
    return {
        "air": MixedSpec(air, _situation("QBHit", "Rush_EPA_Att"), places, (), pass_groups),
        "yac": MixedSpec(yac, _situation("QBHit", "AirYards", "Rush_EPA_Att"), places,
                         (("AirYards", "Receiver_Position"),), pass_groups),
        "qb_rush": MixedSpec(measure, _situation("Pass_EPA_Att"),
                             groups=("Rusher_ID_Name", "DefensiveTeam")),
        "main_rush": MixedSpec(measure, _situation("Pass_EPA_Att"), {"Rusher_Position": "RB"},
                               groups=("Team_Side_Gap", "Rusher_ID_Name", "DefensiveTeam")),
    }


# The two documented model sets (both use EPA-per-attempt covariates).
EP_MODELS = _model_set("EPA", "airEPA_Result", "yacEPA_Result")
WP_MODELS = _model_set("WPA", "airWPA_Result", "yacWPA_Result")

FIT_FIELDS = [
    ("kind", T.StringType()),     # "effect", "fixed", "sd"
    ("factor", T.StringType()),   # grouping factor, or null for fixed terms
    ("level", T.StringType()),    # level of the factor, or name of the term
    ("estimate", T.DoubleType()),
    ("sd", T.DoubleType()),       # conditional sd of an effect
]


def _factor_values(
    inputs: Mapping[str, tuple[DataFrame, MixedSpec]]
) -> dict[str, dict[str, list[str]]]:
    """Values of every model's fixed factors, read once for the design's columns.

    At most ``MAX_FACTOR_VALUES`` + 1 values of a factor reach the driver.
    """
    parts = [
        rows.select(F.lit(m).alias("model"), F.lit(n).alias("factor"),
                    F.col(n).cast("string").alias("value")).distinct().limit(MAX_FACTOR_VALUES + 1)
        for m, (rows, spec) in inputs.items() for n in spec.factors
    ]
    out: dict[str, dict[str, list[str]]] = {m: {n: [] for n in spec.factors}
                                            for m, (_, spec) in inputs.items()}
    for r in union_all(parts).collect() if parts else []:
        out[r["model"]][r["factor"]].append(r["value"])
    for m, factors in out.items():
        for n, values in factors.items():
            if len(values) > MAX_FACTOR_VALUES:
                raise ValueError(f"{m}: {n} has too many values; make it a grouping factor")
            values.sort()
    return out


def _design(spec: MixedSpec, values: Mapping[str, list[str]]) -> _Design:
    """Treatment-contrast columns: intercept, numeric terms, dummies, products."""
    names, cols = ["(Intercept)"], [F.lit(1.0)]
    for n in spec.numeric:
        names.append(n)
        cols.append(F.col(n).cast("double"))
    dummies: dict[str, list[tuple[str, Column]]] = {}
    for n, reference in spec.factors.items():
        levels = values[n]
        base = reference if reference in levels else (levels[0] if levels else None)
        dummies[n] = [
            (f"{n}={v}", (F.col(n) == v).cast("double")) for v in levels if v != base
        ]
        names += [d[0] for d in dummies[n]]
        cols += [d[1] for d in dummies[n]]
    for num, fac in spec.interactions:
        for name, c in dummies[fac]:
            names.append(f"{num}:{name}")
            cols.append(F.col(num).cast("double") * c)
    return _Design(names, cols)


def gram(
    rows: DataFrame, spec: MixedSpec, design: _Design, keys: Sequence[str],
    weight: str | None = None,
) -> DataFrame:
    """Sufficient statistics of one model: (keys, factor_a, level_a, factor_b, level_b, stats).

    Without factors: upper triangle of [X y]'[X y]. One factor: sums of [X y]
    per level. Two factors: number of plays per pair of levels.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    xy = [*design.columns, F.col(spec.response).cast("double")]
    k = len(xy)
    base = rows.select(
        *keys, *[F.col(g).cast("string").alias(g) for g in spec.groups], w.alias("_w"), *[c.alias(f"_x{i}") for i, c in enumerate(xy)]
    )
    none = F.lit(None).cast("string")

    def shape(df: DataFrame, fa: Column, la: Column, fb: Column, lb: Column, stats: Column):
        return df.select(
            *keys, fa.alias("factor_a"), la.alias("level_a"), fb.alias("factor_b"),
            lb.alias("level_b"), stats.alias("stats"),
        )

    def packed(n: int) -> Column:
        return F.expr(f"array({', '.join(f'_s{i}' for i in range(n))})")

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    total = base.groupBy(*keys).agg(
        *[F.expr(f"sum(_w * _x{i} * _x{j}) as _s{n}") for n, (i, j) in enumerate(pairs)]
    )
    parts = [shape(total, none, none, none, none, packed(len(pairs)))]

    # Grouping sets read the rows once for all factors, and once for all pairs.
    # Rows are complete, so a null level means "not grouped by this factor".
    def named(which: Sequence[str]) -> tuple[Column, Column]:
        """Name and level of the first factor a row is grouped by."""
        present = [(g, F.col(g).isNotNull()) for g in which]
        factor = F.coalesce(*[F.when(here, F.lit(g)) for g, here in present])
        return factor, F.coalesce(*[F.col(g) for g in which])

    groups = list(spec.groups)
    by = [*keys, *groups]
    one = base.groupingSets([[*keys, g] for g in groups], *by).agg(
        *[F.expr(f"sum(_w * _x{i}) as _s{i}") for i in range(k)]
    )
    parts.append(shape(one, *named(groups), none, none, packed(k)))
    double = [(a, b) for i, a in enumerate(groups) for b in groups[i + 1:]]
    if double:
        two = base.groupingSets([[*keys, a, b] for a, b in double], *by).agg(F.sum("_w").alias("_n"))
        parts.append(shape(two, *named(groups), *named(groups[::-1]), F.array("_n")))
    return union_all(parts)


def complete_rows(plays: DataFrame, spec: MixedSpec) -> DataFrame:
    """Rows in which no column of the model is missing."""
    cond = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in spec.columns()])
    return plays.where(cond)


def _fit_schema(frame: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType(
        [frame.schema[k] for k in keys] + [T.StructField(n, t) for n, t in FIT_FIELDS]
    )


def crossed_effects(
    models: Mapping[str, tuple[DataFrame, MixedSpec]],
    run_keys: Sequence[str] = ("Season",),
    weight: str | None = None,
    theta: Mapping[str, Sequence[float]] | None = None,
    max_grouped_levels: int | None = None,
) -> DataFrame:
    """Fit several models for every run; one long table of results.

    Returns (run keys, model, kind, factor, level, estimate, sd). ``theta`` fixes
    the relative standard deviations of a model's grouping factors, in their
    declared order, instead of estimating them. Every run is solved in a task of its
    own, whatever its size, unless ``max_grouped_levels`` is given: runs with more
    levels than that are then solved with the largest factor left distributed, see
    :mod:`gridvalue.operators.wide_effects`, whose estimates differ in their last digits.
    """
    names: dict[str, list[str]] = {}
    groups = {m: list(spec.groups) for m, (_, spec) in models.items()}
    parts = []
    inputs = {m: (complete_rows(plays, spec), spec) for m, (plays, spec) in models.items()}
    values = _factor_values(inputs)
    for model, (rows, spec) in inputs.items():
        design = _design(spec, values[model])
        names[model] = design.names
        parts.append(gram(rows, spec, design, run_keys, weight).withColumn("model", F.lit(model)))
    keys = [*run_keys, "model"]
    stats = settle(union_all(parts), "gram")
    fixed_theta = {m: list(v) for m, v in (theta or {}).items()}

    sizes = stats.where(F.col("factor_a").isNotNull() & F.col("factor_b").isNull())
    sizes = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("levels"))
    wide = F.lit(False) if max_grouped_levels is None else F.col("levels") > max_grouped_levels
    runs = sizes.agg(F.count(F.lit(1)).alias("all"), F.count_if(wide).alias("wide")).first()
    # A run is little data but much arithmetic: fix the number of tasks, which
    # keeps adaptive execution from merging them.
    cores = stats.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(runs["all"], 4 * cores))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        model = pdf["model"].iloc[0]
        system = reml.assemble(pdf, groups[model], len(names[model]))
        out = reml.fit(system, names[model], fixed_theta.get(model))
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    def grouped(frame: DataFrame) -> DataFrame:
        return frame.repartition(tasks, *keys).groupBy(*keys).applyInPandas(solve, schema)

    schema = _fit_schema(stats, keys)
    if not runs["wide"]:
        return grouped(stats)

    from .wide_effects import solve_wide

    large = settle(sizes.where(wide).select(*keys), "large_runs")
    small = grouped(stats.join(large, keys, "left_anti"))
    rest = solve_wide(stats.join(large, keys, "left_semi"), keys, groups, names, fixed_theta, schema)
    return small.unionByName(rest)


def effects_of(fits: DataFrame, model: str, factor: str) -> DataFrame:
    """Effects of one grouping factor: (run keys, level, estimate, sd)."""
    hit = (F.col("kind") == "effect") & (F.col("model") == model) & (F.col("factor") == factor)
    return fits.where(hit).drop("kind", "model", "factor")




def passing_effects(
    passing: DataFrame, specs: Mapping[str, MixedSpec] = WP_MODELS,
    run_keys: Sequence[str] = ("Season",), weight: str | None = None,
) -> DataFrame:
    """Air and after-catch models."""
    return crossed_effects({m: (passing, specs[m]) for m in ("air", "yac")}, run_keys, weight)


def rushing_inputs(rushing: DataFrame) -> dict[str, DataFrame]:
    """Quarterback rushes (with sacks) and all other rushes."""
    qb = F.col("Rusher_Position") == "QB"
    return {"qb_rush": rushing.where(qb), "main_rush": rushing.where(~qb)}


def rushing_effects(
    rushing: DataFrame, specs: Mapping[str, MixedSpec] = WP_MODELS,
    run_keys: Sequence[str] = ("Season",), weight: str | None = None,
) -> DataFrame:
    """Quarterback and main rushing models."""
    inputs = rushing_inputs(rushing)
    return crossed_effects({m: (inputs[m], specs[m]) for m in inputs}, run_keys, weight)


def fit_season_models(tables, specs: Mapping[str, MixedSpec] = WP_MODELS, **options) -> DataFrame:
    """All four models of every run in one grouped solve.

    The columns the models use are written first: each model reads them several
    times, and relabelling by joins need not be repeated.
    """
    def needed(frame: DataFrame, models: Sequence[str], *more: str) -> DataFrame:
        cols = dict.fromkeys([*tables.run_keys, *more, *([tables.weight] if tables.weight else [])])
        for m in models:
            cols |= dict.fromkeys(specs[m].columns())
        return settle(frame.select(*cols), f"inputs_{models[0]}", codec=PLAYS_CODEC)

    passing = needed(tables.passing, ["air", "yac"])
    rushing = rushing_inputs(needed(tables.rushing, ["qb_rush", "main_rush"], "Rusher_Position"))
    inputs = {"air": passing, "yac": passing, **rushing}
    return crossed_effects(
        {m: (inputs[m], specs[m]) for m in inputs}, tables.run_keys, tables.weight, **options
    )
