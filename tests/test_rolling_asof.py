"""Sliding order statistics, window functions, products, back fill and the as-of join against plain versions."""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_features import bars_from
from tidebars.functions.expr import ncol
from tidebars.operators import rolling as R
from tidebars.operators.asof import WIDTHS, asof_by_symbol, slice_width
from tidebars.plans.layout import Laid, lay_out, settle

KEEP = ["symbol", "seq"]


@pytest.fixture(scope="module")
def series():
    rnd = np.random.default_rng(4)
    x = 50 + rnd.normal(size=230).cumsum().round(1)
    x[rnd.random(230) < 0.04] = np.nan
    x[100:115] = x[100]
    return x


def laid_of(spark, x, rows):
    laid = lay_out(bars_from(spark, np.arange(len(x)) + 1.0), rows)
    values = spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "seq long, x double")
    return Laid(settle(laid.df.join(values, "seq"), "test"), rows)


def column(df, name):
    return df.toPandas().sort_values("seq")[name].to_numpy(float)


@pytest.mark.parametrize("rows", [7, 50, 1000])
def test_windows_match_pandas(spark, series, rows):
    laid, s = laid_of(spark, series, rows), pd.Series(series)
    got = R.rolling_quantiles(laid, "x", {"a": (9, 0.5), "b": (9, 0.1), "c": (40, 0.75), "d": (1, 0.5), "e": (300, 0.5)}, KEEP)
    for name, n, share in (("a", 9, 0.5), ("b", 9, 0.1), ("c", 40, 0.75), ("d", 1, 0.5), ("e", 300, 0.5)):
        assert np.allclose(column(got, name), s.rolling(n).quantile(share), equal_nan=True), name
    for n in (2, 25):
        assert np.allclose(column(R.rolling_deviation(laid, "x", n, "d", KEEP), "d"), s.rolling(n).std(), equal_nan=True, atol=1e-9)
        assert np.allclose(column(R.rolling_apply(laid, ["x"], n, "r", lambda w: w.max(axis=1) - w.min(axis=1), KEEP), "r"), s.rolling(n).max() - s.rolling(n).min(), equal_nan=True)
    both = R.rolling_apply(laid, ["x", "close"], 6, "c", lambda w: (w[:, 0] * w[:, 1]).sum(axis=1), KEEP)
    assert np.allclose(column(both, "c"), (s * (np.arange(len(s)) + 1)).rolling(6).sum(), equal_nan=True)


def test_deviations_keep_their_digits():
    x = 1e9 + np.random.default_rng(1).normal(size=20_000)
    assert np.allclose(R.deviations(x, 50)[49:], np.std(np.lib.stride_tricks.sliding_window_view(x - 1e9, 50), axis=1, ddof=1), rtol=1e-5)
    assert np.isnan(R.deviations(np.full(5, np.nan), 2)).all() and len(R.deviations(np.zeros(0), 3)) == 0


def test_a_long_window_costs_little_more_than_a_short_one():
    x = np.random.default_rng(2).normal(size=60_000)

    def seconds(n):
        t = time.perf_counter()
        R.sliding_quantiles(x, n, [0.5])
        return time.perf_counter() - t

    assert min(seconds(300) for _ in range(3)) < 3 * min(seconds(10) for _ in range(3))


def test_parameters_of_windows(spark, series):
    laid = laid_of(spark, series, 50)
    for bad in ((0, 0.5), (5, 1.5)):
        with pytest.raises(ValueError):
            R.rolling_quantiles(laid, "x", {"q": bad}, KEEP)
    with pytest.raises(ValueError):
        R.rolling_deviation(laid, "x", 1, "d", KEEP)


@pytest.mark.parametrize("rows", [4, 100])
def test_running_product(spark, rows):
    for x in ([2.0, -1.0, np.nan, -3.0, 0.5, -2.0, 1.0, 4.0, -1.0, 0.25], [2.0, 3.0, 0.0, 5.0, -1.0], [np.nan, np.nan, 2.0]):
        got = column(R.running_product(laid_of(spark, np.array(x), rows), ncol("x"), "p", KEEP), "p")
        assert np.allclose(got, pd.Series(x).fillna(1.0).cumprod())


@pytest.mark.parametrize("rows", [3, 100])
@pytest.mark.parametrize("limit", [None, 2])
def test_back_fill(spark, rows, limit):
    x = np.array([np.nan, np.nan, np.nan, 1.0, np.nan, 2.0, *[np.nan] * 11, 7.0, np.nan])
    got = column(R.back_fill(laid_of(spark, x, rows), ["x"], KEEP, limit), "x")
    want = pd.Series(x).bfill() if limit is None else [next((x[j] for j in range(i, min(i + limit, len(x) - 1) + 1) if not np.isnan(x[j])), np.nan) for i in range(len(x))]
    assert np.allclose(got, want, equal_nan=True)


START = dt.datetime(2021, 3, 1)


def asof_tables(spark, seed=3, bars=400, refs=60):
    rnd = np.random.default_rng(seed)
    at = lambda minutes: START + dt.timedelta(minutes=int(minutes))
    # Half of the bars of A stand in one busy day; reference rows repeat some times.
    b = [("A", at(rnd.integers(0, 1440) if i % 2 else rnd.integers(0, 400_000)), i) for i in range(bars)]
    b += [("B", at(m), 1000 + i) for i, m in enumerate(rnd.integers(0, 400_000, 50))] + [("C", at(5), 2000), (None, at(5), 2001), ("A", None, 2002)]
    r = [("A", at(m), int(v), float(v)) for m, v in zip(rnd.integers(-500, 300_000, refs), rnd.integers(0, 9, refs))]
    r += [("A", b[5][1], 1, 0.5), ("A", b[5][1], 2, 0.25), ("A", b[5][1], 2, 0.75), ("B", at(-99_999), 1, 7.0), ("A", None, 9, 9.0), (None, at(0), 9, 9.0), ("D", at(0), 9, 9.0)]
    return b, r, spark.createDataFrame(b, "symbol string, ts timestamp, id long"), spark.createDataFrame(r, "symbol string, ts timestamp, version int, value double").withColumn("id", F.lit("x"))


@pytest.mark.parametrize("width, most", [(None, 200_000), (None, 30), (86_400, 1), (1, 1), (WIDTHS[0], 1)])
def test_asof_by_symbol(spark, width, most):
    b, r, bars, ref = asof_tables(spark)
    got = {x.id: (x.ref_ts, x.version, x.value) for x in asof_by_symbol(bars, ref, ["version", "value"], ("version",), width, most).collect()}
    want = {}
    for s, ts, i in b:
        old = [x for x in r if x[0] == s and s is not None and ts is not None and x[1] is not None and x[1] <= ts]
        want[i] = max((x[1], x[2], x[3]) for x in old) if old else (None, None, None)
    assert got == want


def test_slices_narrow_until_none_is_too_full(spark):
    _, _, bars, _ = asof_tables(spark)
    widths = [slice_width(bars, most) for most in (10_000, 210, 40, 1)]
    assert widths == sorted(widths, reverse=True) and widths[0] == WIDTHS[0] and widths[2] <= 86_400


def test_asof_of_empty_tables_and_clashes(spark):
    b, _, bars, ref = asof_tables(spark)
    none = asof_by_symbol(bars, ref.filter("false"), ["value"])
    assert none.count() == len(b) and none.filter("value is not null").count() == 0
    assert asof_by_symbol(bars.filter("false"), ref, ["value"]).count() == 0
    with pytest.raises(ValueError):
        asof_by_symbol(bars.withColumn("value", F.lit(1)), ref, ["value"])
