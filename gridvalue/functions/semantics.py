"""Missing-value, ratio and label rules shared by every operator.

The engine reproduces statistics whose definitions rest on these conventions:
missing label parts are spelled out, empty sums are zero, strict sums are
missing as soon as one term is, and ratios follow IEEE arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def label(*parts: str | Column, sep: str = "-") -> Column:
    """Join parts into one string; a missing part becomes the text ``NA``."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("NA")) for c in cols])


def ieee_div(num: Column, den: Column) -> Column:
    """``num / den`` as doubles with x/0 = ±Infinity and 0/0 = NaN."""
    n, d = num.cast("double"), den.cast("double")
    return F.when(d != 0, n / d).when(d == 0, n * F.lit(INF))


def sql_div(num: str, den: str) -> str:
    """SQL text of :func:`ieee_div`."""
    n, d = f"double({num})", f"double({den})"
    return f"case when {d} <> 0 then {n} / {d} when {d} = 0 then {n} * double('Infinity') end"


def if_known(cond: Column, yes: Column, no: Column) -> Column:
    """Two-way choice that stays missing when the condition is missing."""
    return F.when(cond, yes).when(~cond, no)


def text_flag(col: str | Column, needle: str) -> Column:
    """1 if the text contains ``needle``, else 0; missing text counts as 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.contains(needle), F.lit(1)).otherwise(F.lit(0))


def is_number(col: Column) -> Column:
    """True for a value that is neither null nor NaN."""
    return col.isNotNull() & ~F.isnan(col)


class Tally:
    """Aggregates over rows that may each stand for several copies of a play."""

    def __init__(self, weight: str | None = None):
        self.weight = weight

    def _times(self, x: Column) -> Column:
        return x if self.weight is None else x * F.col(self.weight)

    def rows(self) -> Column:
        if self.weight is None:
            return F.count(F.lit(1))
        return F.coalesce(F.sum(F.col(self.weight)), F.lit(0)).cast("long")

    def rows_where(self, cond: Column) -> Column:
        if self.weight is None:
            return F.count_if(cond)
        return F.coalesce(F.sum(F.when(cond, F.col(self.weight))), F.lit(0)).cast("long")

    def total(self, x: Column) -> Column:
        """Sum that skips nulls and is 0 when nothing is left."""
        return F.coalesce(F.sum(self._times(x)), F.lit(0))

    def strict_total(self, x: Column) -> Column:
        """Sum that is null as soon as one term is null."""
        return F.when(F.count(x) == F.count(F.lit(1)), F.sum(self._times(x)))


def null_safe_join(
    left: DataFrame,
    right: DataFrame,
    on: Iterable[str] | Mapping[str, str],
    how: str = "left",
) -> DataFrame:
    """Equi-join in which a missing key matches a missing key.

    ``on`` maps left key names to right key names (or lists shared names). The
    result carries one key column per pair, under the left name.
    """
    pairs = dict(on) if isinstance(on, Mapping) else {k: k for k in on}
    names = {r: f"_r_{r}" for r in pairs.values()}
    renamed = right.withColumnsRenamed(names)
    cond = None
    for lk, rk in pairs.items():
        eq = left[lk].eqNullSafe(renamed[names[rk]])
        cond = eq if cond is None else cond & eq
    joined = left.join(renamed, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti"):
        return joined
    if how in ("full", "full_outer", "outer"):
        joined = joined.withColumns(
            {lk: F.coalesce(F.col(lk), F.col(names[rk])) for lk, rk in pairs.items()}
        )
    return joined.drop(*names.values())


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Row-bind by column name; columns absent from a frame become null."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to combine")
    return out
