"""Feature plans: hand fixtures, independent references, chunk invariance."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from tidebars.functions.expr import C, H, V, cross_up, diff, ema, lag, lead, mad, pct, roll, run, signal, sma, true, when, wilder, wma
from tidebars.operators import candles, indicators
from tidebars.operators.strategies import registry, uses_future
from tidebars.plans.features import add_features
from tidebars.plans.layout import lay_out


def bars_from(spark, closes, symbol="A", spread=0.5):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(symbol, t0 + dt.timedelta(days=i), float(c), float(c) + spread, float(c) - spread, float(c), 10.0 + i % 3) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def compute(spark, closes, feats, rows=8, **kw):
    laid = lay_out(bars_from(spark, closes, **kw), rows)
    return add_features(laid, feats, ["symbol", "ts", "seq"]).toPandas().sort_values(["symbol", "seq"], ignore_index=True)


def zigzag(n, seed=3):
    rng = np.random.default_rng(seed)
    return (100 + np.cumsum(rng.normal(0, 1, n))).round(3).tolist()


def close_to(got, want, tol=1e-9):
    got = np.array([np.nan if v is None else v for v in got], dtype=float)
    want = np.array(want, dtype=float)
    assert got.shape == want.shape
    assert (np.isnan(got) == np.isnan(want)).all()
    ok = ~np.isnan(want)
    assert np.allclose(got[ok], want[ok], rtol=tol, atol=tol)


def test_ramp_windows_and_rsi(spark):
    d = compute(spark, range(1, 41), {"m": sma(C, 5), "r": indicators.rsi(14), "up": signal(C > lag(C)), "w": wma(C, 3)})
    close_to(d["m"], [np.nan] * 4 + [i - 2.0 for i in range(5, 41)])
    close_to(d["r"], [np.nan] * 13 + [100.0] * 27)
    assert d["up"].tolist() == [0] + [1] * 39
    close_to(d["w"], [np.nan] * 2 + [(3 * i + 2 * (i - 1) + (i - 2)) / 6 for i in range(3, 41)])


def test_flat_has_no_nan_or_error(spark):
    d = compute(spark, [5.0] * 30, {"k": indicators.stoch_k(5), "z": indicators.zscore(5), "loc": indicators.close_location()}, spread=0.0)
    assert d["k"].isna().all() and d["z"].isna().all()
    assert (d["loc"] == 0).all()


def test_recurrences_match_a_plain_loop(spark):
    x = zigzag(90)
    d = compute(spark, x, {"first": ema(C, 5), "seeded": ema(C, 5, "sma"), "adj": ema(C, 5, "adjusted"), "wild": wilder(C, 7), "chain": ema(ema(C, 4, "sma"), 6, "sma")}, rows=10)
    s = pd.Series(x)
    close_to(d["first"], s.ewm(span=5, adjust=False).mean())
    close_to(d["adj"], s.ewm(span=5).mean())

    def seeded(v, n, a):
        out, start = [np.nan] * len(v), next(i for i, q in enumerate(v) if not math.isnan(q)) + n - 1
        y = sum(v[start - n + 1 : start + 1]) / n
        for i in range(start, len(v)):
            y = y if i == start else y + a * (v[i] - y)
            out[i] = y
        return out

    close_to(d["seeded"], seeded(x, 5, 2 / 6))
    close_to(d["wild"], seeded(x, 7, 1 / 7))
    close_to(d["chain"], seeded(seeded(x, 4, 2 / 5), 6, 2 / 7))


def test_windows_match_pandas(spark):
    x = zigzag(80)
    s = pd.Series(x)
    d = compute(spark, x, {
        "sd": roll("stddev_samp", C, 10), "med": roll("percentile", C, 7, p=0.5), "mad": mad(C, 6), "cen": roll("max", C, 5, hi=2),
        "tot": run("sum", C), "top": run("max", C), "age": roll("age_max", C, 9), "ahead": lead(C, 3)}, rows=16)
    close_to(d["sd"], s.rolling(10).std())
    close_to(d["med"], s.rolling(7).median())
    close_to(d["mad"], s.rolling(6).apply(lambda v: np.abs(v - v.mean()).mean()))
    close_to(d["cen"], s.rolling(5, center=True).max())
    close_to(d["tot"], s.cumsum())
    close_to(d["top"], s.cummax())
    close_to(d["age"], s.rolling(9).apply(lambda v: 8 - (len(v) - 1 - np.argmax(v[::-1]))))
    close_to(d["ahead"], s.shift(-3))


@pytest.mark.parametrize("rows", [7, 64, 1000])
def test_chunk_size_does_not_matter(spark, rows):
    x = zigzag(200)
    feats = {"rsi": indicators.rsi(5, kind="wilder"), "macd": indicators.macd(3, 6, 4)[1], "obv": indicators.obv(), "adx": indicators.adx(4),
             "k": indicators.kama(C, 5), "ss": indicators.supersmoother(C, 6), "mom": pct(C, 10)}
    base = compute(spark, x, feats, rows=100000)
    got = compute(spark, x, feats, rows=rows)
    for n in feats:
        close_to(got[n], base[n], 1e-8)


def test_no_look_ahead(spark):
    x = zigzag(60)
    rules = {n: e for fam in ("oscillators", "breakouts", "returns") for n, e in list(registry()[fam].items())[:8] if not uses_future(e)}
    a = compute(spark, x[:45], rules, rows=32)
    b = compute(spark, x, rules, rows=32).iloc[:45]
    for n in rules:
        assert a[n].tolist() == b[n].tolist(), n


def test_future_rules_are_tagged():
    assert uses_future(signal(lead(C) > C)) and uses_future(registry()["gaps"]["gap_up_le"])
    assert not uses_future(signal(cross_up(C, sma(C, 5))))


def test_candles_by_hand(spark):
    t0 = dt.datetime(2024, 1, 1)
    quiet = [(10.0, 10.6, 9.4, 10.5 if i % 2 else 9.5) for i in range(12)]
    tail = [(10.0, 10.1, 7.9, 8.0), (7.9, 10.6, 7.8, 10.5)]  # black bar, then a white bar around it
    rows = [("A", t0 + dt.timedelta(days=i), o, h, l, c, 1.0) for i, (o, h, l, c) in enumerate(quiet + tail)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    p = candles.patterns()
    assert len(p) == 60
    d = add_features(lay_out(bars, 5), {n: p[n] for n in ("CDLENGULFING", "CDLLONGLINE", "CDLDOJI")}, ["seq"]).toPandas().sort_values("seq")
    assert d["CDLENGULFING"].iloc[-1] == 100
    assert d["CDLDOJI"].sum() == 0


def test_halo_is_bounded_by_the_frames(spark):
    from tidebars.plans.layout import with_halo

    laid = lay_out(bars_from(spark, range(100)), 10)
    assert with_halo(laid, 4).count() == 100 + 9 * 4
    assert with_halo(laid, 0, 2).count() == 100 + 9 * 2
