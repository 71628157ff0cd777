"""Bootstrap replicates as weights.

Resampling a season draws, per team, as many units (plays or whole drives) as it
has, with replacement. Units are numbered once; slot ``i`` of replicate ``s``
takes the unit at a hashed position, so draws are reproducible and independent
of partitioning (see :mod:`gridvalue.operators.replicates`). A replicate is the table
of drawn units with their number of copies; plays carry that number as a weight instead
of being repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import join_side, label, number_rows, scratch_tables, settle, union_all
from .replicates import FIRST_SIM, PLACE, SIZE, START, UNIT, WEIGHTS, replicate_weights
from .tables import PositionTables, SeasonTables

SIM = "sim_id"
COPIES = "copies"


def number_units(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add the unit's place in its team, the team's number of units, and a number
    that is unique over all teams (place + units of the teams before)."""
    numbered = number_rows(df, list(keys), list(order), PLACE, name)
    # One row per team and run, so ordering all of them is a small task.
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    teams = settle(
        numbered.groupBy(*keys).agg(F.max(PLACE).alias(SIZE)).withColumn(
            START, F.coalesce(F.sum(SIZE).over(before), F.lit(0))),
        "team_units",
    )
    return numbered.join(teams, list(keys)).withColumn(UNIT, F.col(START) + F.col(PLACE))


def draw_copies(
    units: DataFrame, keys: Sequence[str], n_sims: int, seed: int = 0, first_sim: int = 1
) -> DataFrame:
    """(sim_id, unit, copies) drawn from numbered units: their replicate weights, a row
    each."""
    weights = replicate_weights(units, keys, n_sims, seed, first_sim)
    each = weights.select(UNIT, FIRST_SIM, F.posexplode(WEIGHTS).alias("_at", COPIES)).where(F.col(COPIES) > 0)
    return each.select((F.col(FIRST_SIM) + F.col("_at")).alias(SIM), UNIT, F.col(COPIES).cast("long").alias(COPIES))


def drive_units(plays: DataFrame, run_keys: Sequence[str] = ("Season",)) -> DataFrame:
    """Distinct drives of each team, numbered in label order."""
    keys = [*run_keys, "posteam"]
    drives = plays.where(F.col("posteam").isNotNull()).select(
        *keys, label("GameID", "Drive").alias("Game_Drive")
    ).distinct()
    return number_units(drives, keys, [F.col("Game_Drive")], "drive_units")


def drive_weights(
    units: DataFrame, keys: Sequence[str], n_sims: int, seed: int = 0, first_sim: int = 1
) -> DataFrame:
    """(keys, Game_Drive, first replicate, weights) of the drives that a replicate draws."""
    # Spark takes weights for as small as the table of teams that they are made from.
    weights = replicate_weights(units, keys, n_sims, seed, first_sim).hint("merge")
    return units.select(*keys, "Game_Drive", UNIT).join(weights, UNIT).drop(UNIT)


def each_replicate(packed: DataFrame) -> DataFrame:
    """A row per replicate that draws the row, with ``sim_id`` and ``copies``, of rows with
    weight vectors."""
    kept = [c for c in packed.columns if c not in (FIRST_SIM, WEIGHTS)]
    each = packed.select(*kept, FIRST_SIM, F.posexplode(WEIGHTS).alias("_at", COPIES)).where(F.col(COPIES) > 0)
    return each.select(*kept, (F.col(FIRST_SIM) + F.col("_at")).alias(SIM), F.col(COPIES).cast("long").alias(COPIES))


def drawn_drives(
    plays: DataFrame, n_sims: int, run_keys: Sequence[str] = ("Season",), seed: int = 0,
    first_sim: int = 1, units: DataFrame | None = None,
) -> DataFrame:
    """Plays drawn by drive, one row each, with the weight vector of their drive."""
    keys = [*run_keys, "posteam"]
    units = drive_units(plays, run_keys) if units is None else units
    weights = join_side(settle(drive_weights(units, keys, n_sims, seed, first_sim), "drawn_drives"))
    tagged = plays.withColumn("Game_Drive", label("GameID", "Drive"))
    return tagged.join(weights, [*keys, "Game_Drive"]).drop("Game_Drive")


def resample_drives(
    plays: DataFrame, n_sims: int, run_keys: Sequence[str] = ("Season",), seed: int = 0,
    first_sim: int = 1, units: DataFrame | None = None,
) -> DataFrame:
    """Plays of every replicate, with ``sim_id`` and ``copies``, drawn by drive."""
    return each_replicate(drawn_drives(plays, n_sims, run_keys, seed, first_sim, units))


def play_units(
    plays: DataFrame, run_keys: Sequence[str] = ("Season",), order_by: Sequence[str] | None = None
) -> DataFrame:
    """Plays numbered within team by ``order_by`` (default: all columns).

    Plays equal in those columns are interchangeable; a row id keeps even a large
    group of equal plays spread over many tasks.
    """
    order = list(order_by or plays.columns)
    teams = plays.where(F.col("posteam").isNotNull())
    teams = settle(teams.withColumn("_row", F.monotonically_increasing_id()), "rows")
    by = [F.col(c) for c in order if c not in run_keys and c != "posteam"]
    units = number_units(teams, [*run_keys, "posteam"], [*by, F.col("_row")], "play_units")
    return units.drop("_row")


def drawn_plays(
    plays: DataFrame, n_sims: int, run_keys: Sequence[str] = ("Season",), seed: int = 0,
    first_sim: int = 1, units: DataFrame | None = None, order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Plays drawn one by one, one row each, with their weight vector."""
    keys = [*run_keys, "posteam"]
    units = play_units(plays, run_keys, order_by) if units is None else units
    weights = replicate_weights(units, keys, n_sims, seed, first_sim).hint("merge")
    kept = [c for c in units.columns if c not in (UNIT, PLACE, SIZE, START)]
    return units.join(weights, UNIT).select(*kept, FIRST_SIM, WEIGHTS)


def resample_plays(
    plays: DataFrame, n_sims: int, run_keys: Sequence[str] = ("Season",), seed: int = 0,
    first_sim: int = 1, units: DataFrame | None = None, order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Plays of every replicate, with ``sim_id`` and ``copies``, drawn one by one."""
    return each_replicate(drawn_plays(plays, n_sims, run_keys, seed, first_sim, units, order_by))


def expand_copies(plays: DataFrame) -> DataFrame:
    """Repeat each play as often as it was drawn (the unweighted form of a replicate)."""
    times = F.sequence(F.lit(1), F.col(COPIES).cast("int"))
    return plays.withColumn("_copy", F.explode(times)).drop("_copy", COPIES)


Pipeline = Callable[[DataFrame, tuple[str, ...], str], SeasonTables]


def simulate_seasons(
    plays: DataFrame, n_sims: int, pipeline: Pipeline, run_keys: Sequence[str] = ("Season",),
    seed: int = 0, drive_level: bool = True, sims_per_batch: int = 100, packed: bool = False,
) -> PositionTables:
    """Run ``pipeline(plays, run_keys, weight)`` on every replicate.

    The pipeline gets the join of plays and drawn units and should write the plays
    it keeps. If ``packed``, these are one row a play with weight vectors, which it writes
    before :func:`each_replicate`. Replicates of a batch are one plan keyed by ``sim_id``;
    batches only bound the size of the intermediate shuffles. Results are written batch by
    batch.
    """
    make_units = drive_units if drive_level else play_units
    resample = drawn_drives if drive_level else drawn_plays
    units = make_units(plays, run_keys)
    results = []
    for start in range(1, n_sims + 1, sims_per_batch):
        n = min(sims_per_batch, n_sims + 1 - start)
        with scratch_tables(plays.sparkSession):
            drawn = resample(plays, n, run_keys, seed, start, units)
            drawn = drawn if packed else each_replicate(drawn)
            tables = pipeline(drawn, (*run_keys, SIM), COPIES)
            results.append({
                k: settle(v, f"sim_{k}", keep=True) for k, v in tables.positions().items()
            })
    return stack_results(results)


def stack_results(results: Sequence[dict[str, DataFrame]]) -> PositionTables:
    """Row-bind the position tables of several runs."""
    return PositionTables(*[union_all(r[p] for r in results) for p in ("QB", "RB", "WR", "TE")])


def bootstrap_splits(
    plays: DataFrame, kind: str, splits: Sequence[str], n_sims: int,
    run_keys: Sequence[str] = ("Season",), seed: int = 0, units: DataFrame | None = None,
) -> DataFrame:
    """Split statistics of every drive-level replicate.

    Plays are summed per (split, drive) once; replicates only weight those sums, all of
    them in one pass. ``splits`` must include the run keys. ``units`` are the drives to
    draw from, by default those of ``plays``. Plays are dealt by drive, so that neither
    their sums nor the join of these with the weights shuffles the many totals.
    """
    from .splits import drive_totals, measures_from_drives

    keys = [*run_keys, "posteam"]
    drive = [*keys, "Game_Drive"]
    units = drive_units(plays, run_keys) if units is None else units
    dealt = plays.withColumn("Game_Drive", label("GameID", "Drive")).repartition(*drive)
    totals = drive_totals(dealt, kind, [*splits, *[k for k in drive if k not in splits]])
    weights = drive_weights(units, keys, n_sims, seed).hint("merge")
    weighted = settle(totals.join(weights, drive).drop("Game_Drive"), "drive_weights")
    return measures_from_drives(weighted, kind, splits, SIM)
