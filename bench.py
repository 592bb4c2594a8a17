"""Headline queries on local[BENCH_CPUS]; prints one JSON line.

Each number is the median of BENCH_RUNS runs (default 1) after one warm-up query
for the whole session; results go to the no-op sink.  ``bars_*`` build bars from the raw tables; the
other queries read the laid-out bar table that a session builds once
(``layout_*`` is that build).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def session() -> SparkSession:
    s = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
        .config("spark.tidebars.chunkRows", "65536").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def main() -> None:
    from tidebars import workloads as W
    from tidebars.operators import candles, indicators, labels
    from tidebars.operators.strategies import registry
    from tidebars.plans import shelf as shelf_mod
    from tidebars.plans.features import add_features

    spark = session()
    cat, rules = indicators.catalogue(), registry()
    means = {n: cat[n] for n in cat if n.startswith(("MA_", "EMA_"))}

    def feats(table, wanted):
        return lambda: add_features(shelf_mod.shelf(spark, SF_DIR, table), wanted, ["symbol", "ts"])

    def layout(table):
        def run():
            shelf_mod._SHELF.clear()
            return shelf_mod.shelf(spark, SF_DIR, table).df

        return run

    plain = lambda fn: lambda: fn(spark, SF_DIR)
    jobs = {
        "bars_part_daily": plain(W.bars_of("part_daily")),
        "bars_market_daily": plain(W.bars_of("market_daily")),
        "layout_part_daily": layout("part_daily"),
        "moving_averages_part_daily": feats("part_daily", means),
        "indicator_catalogue_part_daily": feats("part_daily", cat),
        "candles_part_daily": feats("part_daily", candles.patterns()),
        "signals_two_mean_events_part_daily": feats("part_daily", rules["two_mean_events"]),
        "signals_relative_strength_part_daily": feats("part_daily", rules["relative_strength"]),
        "signals_breakouts_part_daily": feats("part_daily", rules["breakouts"]),
        "direction_targets_part_daily": feats("part_daily", labels.direction_targets()),
        "winsor_rank_log": plain(W.winsor_rank_log),
        "macro_asof": plain(W.macro_asof),
        "trade_ledger": plain(W.trade_ledger),
        "truth_trades_suffix": plain(W.truth_trades_suffix),
        "psar": plain(W.psar),
        "feature_profile": plain(W.feature_profile),
        "mutual_information": plain(W.mutual_information),
    }
    picked = sys.argv[1:]
    feats("flag_daily", means)().write.format("noop").mode("overwrite").save()
    times = {}
    for name, job in jobs.items():
        if picked and name not in picked:
            continue
        runs = []
        for _ in range(RUNS):
            t = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    bars = shelf_mod.shelf(spark, SF_DIR, "part_daily").df.count()
    out = {
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(CPUS), "part_daily_bars": bars,
    }
    if "indicator_catalogue_part_daily" in times:
        out["catalogue_rows_per_sec"] = round(bars / times["indicator_catalogue_part_daily"])
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
