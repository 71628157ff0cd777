"""The tables that travel through the season pipeline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class PositionTables:
    """One row per player, position by position."""

    qb: DataFrame
    rb: DataFrame
    wr: DataFrame
    te: DataFrame

    def positions(self) -> dict[str, DataFrame]:
        return {"QB": self.qb, "RB": self.rb, "WR": self.wr, "TE": self.te}


@dataclass(frozen=True)
class SeasonTables:
    """Modelling plays and position tables of every run (season, replicate, ...).

    ``run_keys`` name the columns that tell runs apart; every operator groups by
    them, so many seasons or replicates are one plan. ``weight`` names a column
    with the number of copies a play stands for, if plays carry one.
    """

    passing: DataFrame | None = None
    rushing: DataFrame | None = None
    qb: DataFrame | None = None
    rb: DataFrame | None = None
    wr: DataFrame | None = None
    te: DataFrame | None = None
    run_keys: tuple[str, ...] = ("Season",)
    weight: str | None = None
    fits: DataFrame | None = None

    def positions(self) -> dict[str, DataFrame]:
        named = {"QB": self.qb, "RB": self.rb, "WR": self.wr, "TE": self.te}
        return {k: v for k, v in named.items() if v is not None}

    def with_positions(self, tables: dict[str, DataFrame]) -> SeasonTables:
        return replace(self, **{k.lower(): v for k, v in tables.items()})

    def map_positions(self, fn: Callable[[str, DataFrame], DataFrame]) -> SeasonTables:
        return self.with_positions({k: fn(k, v) for k, v in self.positions().items()})
