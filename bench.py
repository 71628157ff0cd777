"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # one solve per task, not per core
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ONLY = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]


def session() -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{CPUS}]").appName("gridvalue-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        # HotSpot never compiles larger methods; smaller generated ones run faster.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def drain(df: DataFrame) -> None:
    """Compute every column of every row without bringing rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    from gridvalue.operators.bootstrap import bootstrap_splits, drive_units
    from gridvalue.operators.preparation import pass_plays
    from gridvalue.operators.splits import passing_splits
    from gridvalue.plans import season
    from gridvalue.registry import _stored
    from gridvalue.sources import games_from_tables, plays_from_tables, rosters_from_tables
    from gridvalue.functions import settle

    made: dict[str, object] = {}

    def ingest():
        plays = settle(plays_from_tables(spark, SF_DIR), "plays")
        made["plays"] = season.model_plays(plays, rosters_from_tables(spark, SF_DIR))

    def splits():
        drain(passing_splits(pass_plays(made["plays"]), ["Season", "Passer_ID_Name"]))

    def war():
        out = season.wins_from_probability(made["plays"])
        made["season"] = out.map_positions(lambda p, t: settle(t, f"bench_{p}"))

    def war_points():
        out = season.wins_from_points(made["plays"], games_from_tables(spark, SF_DIR))
        for t in out.positions().values():
            drain(t)

    def boot_splits():
        drain(bootstrap_splits(
            pass_plays(made["plays"]), "passing", ["Season", "Passer_ID_Name"], 100,
            units=drive_units(made["plays"])))

    def boot_war():
        out = season.bootstrap_wins(made["plays"], _stored(made["season"]), 20, sims_per_batch=20)
        for t in out.positions().values():
            drain(t)

    steps = {
        "ingest": ingest, "passing_splits": splits, "season_war_4_fits": war,
        "season_war_points": war_points, "bootstrap_splits_100": boot_splits,
        "bootstrap_war_20": boot_war,
    }
    times = {}
    for name, step in steps.items():
        if ONLY and name not in ONLY:
            continue
        start = time.perf_counter()
        step()
        times[name] = round(time.perf_counter() - start, 2)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 2), "unit": "sec",
        "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
