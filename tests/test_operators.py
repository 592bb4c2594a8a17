"""Folds, labels, ledgers, joins, preparation and streams on small fixtures."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_features import bars_from, zigzag
from tidebars.functions.expr import C, lag, ncol, when
from tidebars.operators import cross_asset, evaluate, folds, labels, ledger, models, prep, select
from tidebars.plans.layout import Laid, lay_out, settle
from tidebars.sources import bars as B


def laid_of(spark, closes, rows=9):
    laid = lay_out(bars_from(spark, closes), rows)
    return Laid(settle(laid.df, "test"), rows)


def test_cooldown_keeps_every_tenth(spark):
    laid = laid_of(spark, range(1, 61))
    hits = Laid(laid.df.withColumn("hit", F.lit(1.0)), laid.rows)
    d = folds.cooldown(hits, 10).filter("signal = 1").toPandas()
    assert sorted(d["seq"]) == [0, 10, 20, 30, 40, 50]


@pytest.mark.parametrize("rows", [7, 500])
def test_folds_do_not_depend_on_chunks(spark, rows):
    x = zigzag(300)
    a = folds.parabolic(laid_of(spark, x, rows)).toPandas().sort_values("seq")
    b = folds.parabolic(laid_of(spark, x, 100000)).toPandas().sort_values("seq")
    assert np.allclose(a["sar"].fillna(-1), b["sar"].fillna(-1))
    assert (a["side"].fillna(0).values == b["side"].fillna(0).values).all()


def brute_optimal(p, need, ok):
    n = len(p)
    dp = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        dp[i] = dp[i + 1]
        if ok[i]:
            for j in range(i + 1, n):
                g = p[j] - p[i]
                if g >= need[i] and g + dp[j + 1] > dp[i]:
                    dp[i] = g + dp[j + 1]
    return dp[0]


@pytest.mark.parametrize("side", ["long", "short"])
@pytest.mark.parametrize("rows, warm", [(25, 512), (25, 3), (7, 1), (1000, 512)])
def test_optimal_trades_match_brute_force(spark, side, rows, warm):
    laid = laid_of(spark, zigzag(120, 11), rows)
    g = labels.gates(laid).toPandas().sort_values("seq")
    sign = 1 if side == "long" else -1
    best = brute_optimal((g["close"] * sign).tolist(), g["need"].tolist(), g["open_ok"].tolist())
    t = labels.optimal_trades(laid, side, warm).toPandas().sort_values("entry_seq")
    assert abs(t["profit"].sum() - best) < 1e-9
    assert (t["entry_seq"].values[1:] > t["exit_seq"].values[:-1]).all()
    greedy = labels.truth_trades(laid, side).toPandas()["profit"].sum()
    assert best >= greedy - 1e-9


@pytest.mark.parametrize("chunks", [8, 40])
def test_optimal_trades_forget_far_exits(spark, chunks):
    # However many chunks there are, a few rounds settle a series that swings.
    x = 50 + 10 * np.sin(np.arange(chunks * 50) / 4) + np.random.default_rng(2).normal(size=chunks * 50)
    a = labels.optimal_trades(laid_of(spark, x, 50), "long", 60, 2).toPandas().sort_values("entry_seq")
    b = labels.optimal_trades(laid_of(spark, x, 100_000), "long").toPandas().sort_values("entry_seq")
    assert a["entry_seq"].tolist() == b["entry_seq"].tolist() and a["exit_seq"].tolist() == b["exit_seq"].tolist() and len(a) > 2 * chunks


def test_best_later_exit_matches_brute_force(spark):
    laid = laid_of(spark, zigzag(100, 5), 12)
    g = labels.gates(laid).toPandas().sort_values("seq", ignore_index=True)
    got = labels.best_later_exit(laid, "long").toPandas().sort_values("seq", ignore_index=True)
    p = g["close"].tolist()
    for i in range(len(p)):
        later = p[i + 1 :]
        want = None
        if later and g["open_ok"][i] and max(later) - p[i] >= g["need"][i] and max(later) > p[i]:
            want = i + 1 + later.index(max(later))
        assert (None if pd.isna(got["exit_seq"][i]) else int(got["exit_seq"][i])) == want


def test_ledger_closes_first_then_long_then_short(spark):
    laid = laid_of(spark, [10, 11, 12, 11, 10, 9, 8, 9, 10, 11, 12, 13], 4)
    from tidebars.functions.expr import SEQ

    t = ledger.signal_ledger(laid, SEQ.isin([1, 4]), SEQ.isin([1, 6]), SEQ.isin([4, 6, 9]), 1.0).toPandas().sort_values("entry_seq")
    assert t[["side", "entry_seq", "exit_seq", "pnl"]].values.tolist() == [["long", 1, 4, -1.0], ["long", 4, 6, -2.0], ["short", 6, 9, -3.0]]
    b = ledger.balance(ledger.signal_ledger(laid, SEQ.isin([1, 4]), SEQ.isin([1, 6]), SEQ.isin([4, 6, 9]), 1.0), 100.0, 2).toPandas().sort_values("exit_ts")
    assert b["balance"].tolist() == [99.0, 97.0, 94.0]


def test_asof_join_takes_the_latest(spark):
    bars = bars_from(spark, range(10))
    ref = spark.createDataFrame([(dt.datetime(2024, 1, 3), 1.0), (dt.datetime(2024, 1, 7, 12), 2.0)], "ts timestamp, v double")
    d = cross_asset.asof_join(bars, ref, ["v"]).toPandas().sort_values("ts")
    assert d["v"].fillna(0).tolist() == [0, 0, 1, 1, 1, 1, 1, 2, 2, 2]


def test_quantiles_and_ranks_are_exact(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([np.full(4000, 7.0), rng.normal(5, 3, 8000)])  # one value holds a third
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    q = prep.quantile_row(df, ["v"], [0.01, 0.5, 0.9])
    for p in (0.01, 0.5, 0.9):
        assert abs(q[("v", p)] - np.quantile(v, p)) < 1e-12
    r = prep.percent_rank_ties(df, "v", "r").toPandas().sort_values("v", ignore_index=True)
    want = pd.Series(r["v"]).rank(pct=True)
    assert np.allclose(r["r"], want)


def test_time_folds_are_expanding(spark):
    laid = laid_of(spark, range(63), 10)
    d = laid.df.select("seq", prep.time_folds(5).alias("f")).toPandas().sort_values("seq")
    assert d["f"].tolist() == [-1] * 13 + [k for k in range(5) for _ in range(10)]


def test_top_k_survives_a_crowded_period(spark):
    rows = [("S", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), float((i * 37) % 1001)) for i in range(3000)]
    r = spark.createDataFrame(rows, "symbol string, ts timestamp, ret double")
    d = cross_asset.top_per_period(r, "ret", "month", 10).toPandas()
    assert sorted(d["ret"], reverse=True) == sorted((x[2] for x in rows), reverse=True)[:10]


def test_models_and_selection_run(spark):
    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(size=(n, 3))
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 0] * 2, "flat": 1.0, "y": (x[:, 0] > 0).astype(int), "r": x[:, 0] * 3 + x[:, 1], "fold": np.arange(n) * 4 // n - 1})
    df = spark.createDataFrame(pdf)
    assert select.constant_features(df, ["a", "b", "flat"]) == ["flat"]
    assert select.collinear_features(df, ["a", "b", "c"]) == ["a"]
    assert select.select_mutual_information(df, ["a", "b"], "y", 1) == ["a"]
    assert select.select_forest(df, ["a", "b"], "y", True, 1) == ["a"]
    assert select.select_recursive(df, ["a", "b"], "y", True, 1) == ["a"]
    assert select.select_regularised(df, ["a", "b"], "y", True, 2)[0] == "a"
    meta, p = models.stack(df, ["a", "b"], "r", ("forest",), 3)
    assert p.count() == int((pdf["fold"] >= 0).sum())
    m = models.pipeline(["a", "b"], models.classifier("forest", "y", numTrees=5)).fit(df)
    s = models.score(m, df, ["y"])
    assert s.filter("signal = (y = 1)").count() > 360
    f = models.score_with(df, lambda b: b["a"].to_numpy(), ["a"], ["y"])
    assert f.count() == n
    imp = {r["feature"]: r["importance"] for r in select.permutation_importance(df, m, ["a", "b"], "y", True).collect()}
    assert imp["a"] > imp["b"]


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("20240102,09:31:00,1.1,1.2,1.0,1.15,100\n20240102,09:32:00,1.15,1.3,1.1,1.2,50\n")
    d = B.read_raw_bars(spark, str(tmp_path / "raw.csv"), "EURUSD")
    assert d.count() == 2 and d.columns == ["symbol", "ts", "open", "high", "low", "close", "volume"]
    B.write_bars(d, str(tmp_path / "bars"))
    assert B.read_bars(spark, str(tmp_path / "bars")).count() == 2
    odd = spark.createDataFrame([(1.0, 2.0, 0.5, 1.5, 9.0)], "`My Open` double, HIGH double, `low px` double, Close double, `tick volume` double")
    assert B.normalise_columns(odd).columns == ["open", "high", "low", "close", "volume"]
    trial = {"model_type": "LSTM", "trial_id": "1", "status": "COMPLETED", "val_loss": 0.1, "val_accuracy": 0.9, "settings": {"units": "64"}}
    (tmp_path / "trials").mkdir()
    (tmp_path / "trials" / "a.json").write_text(json.dumps(trial))
    (tmp_path / "trials" / "b.json").write_text(json.dumps({**trial, "trial_id": "2", "status": "RUNNING"}))
    t = B.read_trials(spark, str(tmp_path / "trials"))
    assert t.count() == 1
    assert B.shared_settings(B.best_trials(t)).first()["value"] == "64"


def test_stream_drops_repeats_and_late_rows(spark, tmp_path):
    from tidebars.streaming.bars import stream_bars

    def write(name, rows):
        spark.createDataFrame(rows, "id long, ts timestamp, sym string, px double").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    write("a", [(1, t(0, 1), "X", 1.0), (2, t(0, 30), "X", 3.0), (2, t(0, 30), "X", 3.0)])
    schema = "id long, ts timestamp, sym string, px double"
    src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    s = stream_bars(src, F.col("sym"), F.col("px"), F.lit(1.0), ["ts", "id"], "1 hour", "10 minutes", "ts", ["id"])
    q = s.writeStream.format("memory").queryName("late_bars").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    write("b", [(3, t(3, 0), "X", 9.0)])
    q.processAllAvailable()
    write("c", [(4, t(0, 45), "X", 100.0), (5, t(5, 0), "X", 2.0)])  # the first one is late
    q.processAllAvailable()
    q.stop()
    d = spark.table("late_bars").filter(F.col("ts") == F.lit(t(0, 0))).toPandas()
    assert d[["open", "high", "low", "close", "volume"]].values.tolist() == [[1.0, 3.0, 1.0, 3.0, 2.0]]


def test_cycle_period_is_the_strongest_bin_of_the_whole_spectrum(spark):
    from tidebars.operators.sessions import cycle_signals

    rnd, rows, want = np.random.default_rng(8), [], {}
    for name, n, cycle in (("long", 997, 249), ("short", 1000, 2.5), ("walk", 641, None), ("odd", 7, 3), ("two", 2, 2)):
        x = rnd.normal(size=n).cumsum() if cycle is None else 50 + 3 * np.sin(np.arange(n) * 2 * np.pi / cycle + 1) + rnd.normal(size=n) / 9
        want[name] = int(np.round(n / (np.argmax(np.abs(np.fft.fft(x - x.mean())[1 : n // 2 + 1])) + 1)))
        rows += [(name, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)]
    assert want["long"] > 64 and want["short"] < 4
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    for chunk in (16, 100, 5000):
        got = {r.symbol: r.period for r in cycle_signals(lay_out(bars, chunk)).select("symbol", "period").distinct().collect()}
        assert got == want


def test_spectrum_equals_a_plain_transform(spark):
    from tidebars.operators.spectrum import Grid, column_group, power_spectrum

    rnd = np.random.default_rng(3)
    series = {f"n{n}": rnd.normal(size=n) for n in (1, 2, 3, 4, 5, 16, 17, 100, 509, 1024)}
    rows = [(name, i, len(x), float(v)) for name, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, seq bigint, bars bigint, x double")
    for cells in (4, 64, 4096):
        for n in (2, 3, 5, 17, 100, 1024, 10**9):
            grid = Grid.of(n, cells)
            assert grid.tall * grid.wide >= 2 * n - 1 and grid.columns * grid.groups == grid.wide and grid.rows * grid.groups == grid.tall and n >= grid.wide
            assert grid.groups in (1, grid.wide) or grid.tall * grid.columns <= cells
        groups = {(r.symbol, r.seq): r.g for r in df.filter("bars > 1").select("symbol", "seq", column_group(F.col("seq"), F.col("bars"), cells).alias("g")).collect()}
        for (name, seq), g in groups.items():
            grid = Grid.of(len(series[name]), cells)
            assert g == seq % grid.wide // grid.columns
        got = power_spectrum(df, cells).collect()
        for name, x in series.items():
            mine = [r for r in got if r.symbol == name]
            plain = np.abs(np.fft.fft(x)[: len(x) // 2 + 1]) ** 2
            assert all(abs(r.power - plain[r.k]) < 1e-9 * plain.sum() for r in mine)
            if len(x) > 1:
                assert max((r.power, -r.k) for r in mine)[1] == -(np.argmax(plain[1:]) + 1)
                # What is exchanged grows with the series: a row for each pair of groups.
                grid = Grid.of(len(x), cells)
                assert len({r.group for r in mine}) <= grid.groups <= len(x)
