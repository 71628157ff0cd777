"""Split statistics: passing, receiving and rushing measures by any grouping.

Passing and receiving are one catalogue seen from two sides; only the words
differ. Every measure is either an additive total or a ratio of two totals, so
totals are aggregated once and all ratios are projections. Expressions are SQL
text, which reaches the JVM in one call instead of one call per operator.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import null_safe_join, sql_div
from .replicates import weighted_sums

DRIVE = ["GameID", "Drive"]


@dataclass(frozen=True)
class Words:
    """The vocabulary of one side of a passing play."""

    rows: str        # number of plays
    catches: str     # completed plays
    side: str        # prefix of totals
    per_row: str     # suffix of a rate per play
    per_catch: str   # suffix of a rate per catch
    caught: str      # prefix of totals over catches
    share: str       # name of the catch rate
    efficiency: str  # yards per air yard
    picks: str       # interceptions

    @property
    def drives(self) -> str:
        return f"{self.side}_Drives"


PASSING = Words("Pass_Attempts", "Completions", "Pass", "Att", "Comp", "Comp",
                "Comp_Perc", "PACR", "INTs")
RECEIVING = Words("Targets", "Receptions", "Rec", "Tgt", "Rec", "Caught",
                  "Rec_Perc", "RACR", "Rec_INTs")


def _pass_inputs() -> dict[str, tuple[str, str]]:
    """Additive parts of a passing play: name -> (kind, expression)."""
    parts = {
        "catches": ("sum", "Reception"),
        "yards": ("sum", "Yards_Gained"),
        "air_yards": ("sum", "AirYards"),
        "air_yards_caught": ("sum", "Reception * AirYards"),
        "yac": ("sum", "Reception * YardsAfterCatch"),
        "hits": ("sum", "QBHit"),
        "picks": ("sum", "InterceptionThrown"),
        "tds": ("sum", "Touchdown"),
        "air_tds": ("sum", "int(YardsAfterCatch = 0) * Touchdown"),
        "clutch": ("sum", "EPA * abs(WPA)"),
    }
    for m in ("EPA", "WPA"):
        parts[m] = ("sum", m)
        parts[f"{m}_up"] = ("count", f"{m} > 0")
        parts[f"{m}_caught"] = ("sum", f"Reception * {m}")
        parts[f"{m}_abs"] = ("sum", f"abs({m})")
        parts[f"air{m}"] = ("sum", f"Reception * air{m}")
        parts[f"air{m}_up"] = ("count", f"air{m} > 0")
        parts[f"air{m}_caught_up"] = ("count", f"Reception * air{m} > 0")
        parts[f"yac{m}"] = ("sum", f"Reception * yac{m}")
        parts[f"yac{m}_caught_up"] = ("count", f"Reception * yac{m} > 0")
    return parts


def _rush_inputs() -> dict[str, tuple[str, str]]:
    parts = {
        "sacks": ("sum", "Sack"),
        "yards": ("sum", "Yards_Gained"),
        "sack_yards": ("sum", "Sack * Yards_Gained"),
        "tds": ("sum", "Touchdown"),
        "fumbles": ("sum", "Fumble"),
        "clutch": ("sum", "EPA * abs(WPA)"),
    }
    for m in ("EPA", "WPA"):
        parts[m] = ("sum", m)
        parts[f"{m}_up"] = ("count", f"{m} > 0")
        parts[f"{m}_pos"] = ("sum", f"int({m} > 0) * {m}")
        parts[f"{m}_abs"] = ("sum", f"abs({m})")
    return parts


def _pass_measures(w: Words, faithful: bool) -> dict[str, str]:
    """All measures of one side, from the totals ``_<part>``."""
    t = {k: f"_{k}" for k in ("rows", "drives", *_pass_inputs())}
    out = {w.rows: t["rows"], w.catches: t["catches"], w.drives: t["drives"],
           w.share: sql_div(t["catches"], t["rows"])}
    bases = {w.per_row: t["rows"], w.per_catch: t["catches"], "Drive": t["drives"]}

    def rates(stem: str, total: str, drive_word: str = "Drive") -> None:
        for word, base in bases.items():
            name = drive_word if word == "Drive" else word
            out[f"{stem}_per_{name}"] = sql_div(total, base)

    out[f"{w.side}_Yards_Gained"] = t["yards"]
    out["Total_AirYards"] = t["air_yards"]
    out[f"Total_AirYards_{w.per_catch}"] = t["air_yards_caught"]
    out["Total_YardsAfterCatch"] = t["yac"]
    rates("Yards", t["yards"])
    rates("AirYards", t["air_yards"])
    rates(f"AirYards_{w.per_catch}", t["air_yards_caught"])
    rates("YardsAfterCatch", t["yac"])
    out[w.efficiency] = sql_div(t["yards"], t["air_yards"])
    if w is PASSING:
        out["Times_Hit"] = t["hits"]
        rates("Times_Hit", t["hits"])

    out[w.picks] = t["picks"]
    out[f"{w.side}_TDs"] = t["tds"]
    out["Air_TDs"] = t["air_tds"]
    out["Air_TD_Rate"] = sql_div(t["air_tds"], t["tds"])
    out["TD_to_INT"] = sql_div(t["tds"], t["picks"])
    rates("TD", t["tds"])
    rates("Air_TD", t["air_tds"])
    rates(w.picks, t["picks"])
    if w is PASSING:
        if faithful:
            # Known quirk: touchdowns per attempt count air touchdowns only.
            out["TD_per_Att"] = out["Air_TD_per_Att"]
        out["Passer_Rating"] = (
            f"((({out['Comp_Perc']} - 0.3D) * 5) + (({out['Yards_per_Att']} - 3) * 0.25D)"
            f" + ({out['TD_per_Att']} * 20) + (2.375D - {out['INTs_per_Att']} * 25)) / 6 * 100"
        )

    for m, good in (("EPA", "Success"), ("WPA", "Win")):
        out[f"{w.side}_{m}"] = t[m]
        rates(f"{w.side}_{m}", t[m])
        out[f"{w.side}_{good}_Rate"] = sql_div(t[f"{m}_up"], t["rows"])
        out[f"{w.caught}_{m}"] = t[f"{m}_caught"]
        rates(f"{w.caught}_{m}", t[f"{m}_caught"])
        out[f"{m}_{w.per_catch}_Perc"] = sql_div(t[f"{m}_caught"], t[f"{m}_abs"])
        out[f"Total_air{m}"] = t[f"air{m}"]
        rates(f"air{m}", t[f"air{m}"])
        out[f"air_{good}_Rate"] = sql_div(t[f"air{m}_up"], t["rows"])
        out[f"air_{w.per_catch}_{good}_Rate"] = sql_div(t[f"air{m}_caught_up"], t["rows"])
        out[f"Total_yac{m}"] = t[f"yac{m}"]
        rates(f"yac{m}", t[f"yac{m}"])
        out[f"yac_{good}_Rate"] = sql_div(t[f"yac{m}_caught_up"], t["rows"])
    out[f"{w.side}_Clutch_EPA"] = t["clutch"]
    rates(f"{w.side}_Clutch_EPA", t["clutch"], drive_word="Drives")
    return out


def _rush_measures() -> dict[str, str]:
    t = {k: f"_{k}" for k in ("rows", "drives", *_rush_inputs())}
    out = {"Rushes": t["rows"], "Sacks": t["sacks"], "Rush_Drives": t["drives"],
           "Rush_Yards_Gained": t["yards"], "Sack_Yards_Lost": t["sack_yards"],
           "Rush_TDs": t["tds"], "Fumbles": t["fumbles"], "Rush_Clutch_EPA": t["clutch"]}
    stems = {"Rush_Yards": t["yards"], "Rush_TD": t["tds"], "Fumbles": t["fumbles"],
             "Rush_Clutch_EPA": t["clutch"]}
    for m, good in (("EPA", "Success"), ("WPA", "Win")):
        out[f"Rush_{m}"] = t[m]
        stems[f"Rush_{m}"] = t[m]
        out[f"Rush_{good}_Rate"] = sql_div(t[f"{m}_up"], t["rows"])
        out[f"Pos_{m}_Ratio"] = sql_div(t[f"{m}_pos"], t[f"{m}_abs"])
    for stem, total in stems.items():
        out[f"{stem}_per_Rush"] = sql_div(total, t["rows"])
        out[f"{stem}_per_Drive"] = sql_div(total, t["drives"])
    return out


KINDS = {
    "passing": (_pass_inputs, lambda faithful: _pass_measures(PASSING, faithful)),
    "receiving": (_pass_inputs, lambda faithful: _pass_measures(RECEIVING, faithful)),
    "rushing": (_rush_inputs, lambda faithful: _rush_measures()),
}


def _totals(kind: str, weight: str | None) -> list[str]:
    """Aggregates of a kind's additive parts; a weight counts copies of a play."""
    w = weight or "1"
    out = ["count(1) as _rows" if weight is None else f"sum({w}) as _rows"]
    for name, (how, x) in KINDS[kind][0]().items():
        if how == "sum":
            x = x if weight is None else f"({x}) * {w}"
            out.append(f"coalesce(sum({x}), 0) as _{name}")
        else:
            out.append(f"coalesce(sum(case when {x} then {w} end), 0) as _{name}")
    return out


def _keys(splits: Sequence[str]) -> list:
    """Fresh key names, since a key may share its name with a measure."""
    return [F.col(s).alias(f"_key_{s}") for s in splits]


def _measured(summed: DataFrame, kind: str, splits: Sequence[str], faithful: bool) -> DataFrame:
    return summed.selectExpr(
        *[f"`_key_{s}` as `{s}`" for s in splits],
        *[f"{x} as `{n}`" for n, x in KINDS[kind][1](faithful).items()],
    )


def _split(
    plays: DataFrame, kind: str, splits: Sequence[str], weight: str | None, faithful: bool
) -> DataFrame:
    # Drives are counted apart: the totals would else be kept and shuffled by drive.
    keys, drive = [f"_key_{s}" for s in splits], [F.col(d).alias(f"_drive_{d}") for d in DRIVE]
    totals = plays.groupBy(*_keys(splits)).agg(*[F.expr(x) for x in _totals(kind, weight)])
    drives = plays.select(*_keys(splits), *drive).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_drives"))
    return _measured(null_safe_join(totals, drives, keys, "inner"), kind, splits, faithful)


def passing_splits(
    plays: DataFrame, splits: Sequence[str] = ("Passer_ID_Name",),
    weight: str | None = None, faithful: bool = True,
) -> DataFrame:
    """86 passing measures per split."""
    return _split(plays, "passing", splits, weight, faithful)


def receiving_splits(
    plays: DataFrame, splits: Sequence[str] = ("Receiver_ID_Name",), weight: str | None = None
) -> DataFrame:
    """81 receiving measures per split."""
    return _split(plays, "receiving", splits, weight, True)


def rushing_splits(
    plays: DataFrame, splits: Sequence[str] = ("Rusher_ID_Name",), weight: str | None = None
) -> DataFrame:
    """26 rushing measures per split."""
    return _split(plays, "rushing", splits, weight, True)


def drive_totals(plays: DataFrame, kind: str, splits: Sequence[str]) -> DataFrame:
    """Additive totals per (split, drive): the input of a drive bootstrap.

    Every measure is a function of these totals, so replicates weight drives
    instead of repeating plays.
    """
    totals = [F.expr(x) for x in _totals(kind, None)]
    return plays.groupBy(*splits, *[d for d in DRIVE if d not in splits]).agg(*totals)


def measures_from_drives(
    totals: DataFrame, kind: str, splits: Sequence[str], sim: str, faithful: bool = True
) -> DataFrame:
    """Measures per (split, replicate) from written drive totals with replicate weights.

    A split without the team may hold several rows of one drive label, which count as
    one drive.
    """
    sums = [f"_{n}" for n in ("rows", *KINDS[kind][0]())]
    keyed = totals.withColumns({f"_key_{s}": F.col(s) for s in splits})
    summed = weighted_sums(keyed, [f"_key_{s}" for s in splits], DRIVE, sums, "_drives", f"_key_{sim}")
    return _measured(summed, kind, [*splits, sim], faithful)
