"""Ranges of daily sessions and seasonal frequencies."""

from __future__ import annotations

import math
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.expr import C, lag, true, when
from tidebars.operators.spectrum import power_spectrum
from tidebars.plans.features import add_features
from tidebars.plans.layout import Laid


def first_hour_breakout(bars: DataFrame, zone: str, start: int, end: int) -> DataFrame:
    """Per local day the range of the bars in [start, end) minutes; later bars of
    the day that break it.  Partial aggregation per (symbol, day), joined back on both."""
    local = F.from_utc_timestamp("ts", zone)
    minute = F.hour(local) * 60 + F.minute(local)
    b = bars.withColumn("_day", F.to_date(local)).withColumn("_min", minute)
    inside = (F.col("_min") >= start) & (F.col("_min") < end)
    rng = b.groupBy("symbol", "_day").agg(F.max(F.when(inside, F.col("high"))).alias("_hi"), F.min(F.when(inside, F.col("low"))).alias("_lo"))
    sig = F.when((F.col("_min") >= end) & (F.col("high") > F.col("_hi")), 1).when((F.col("_min") >= end) & (F.col("low") < F.col("_lo")), -1).otherwise(0)
    return b.join(rng, ["symbol", "_day"]).select(*bars.columns, sig.alias("signal"))


def up_month_frequency(laid: Laid) -> DataFrame:
    """Share of rising bars per (year, month), averaged over the years."""
    d = add_features(laid, {"up": when(true(C > lag(C)), 1.0, otherwise=0.0), "first": lag(C).eq(lag(C)) }, ["symbol", "ts"])
    d = d.filter("first is not null")
    per = d.groupBy("symbol", F.year("ts").alias("year"), F.month("ts").alias("month")).agg(F.avg("up").alias("share"))
    return per.groupBy("symbol", "month").agg(F.avg("share").alias("frequency"))


def seasonal_signals(laid: Laid, high: float = 0.75, low: float = 0.25) -> DataFrame:
    """Months that rise often are sold, months that rise seldom are bought."""
    freq = up_month_frequency(laid)  # twelve rows per symbol
    d = laid.df.select("symbol", "ts", F.month("ts").alias("month"))
    sig = F.when(F.col("frequency") >= high, -1).when(F.col("frequency") <= low, 1).otherwise(0)
    return d.join(freq, ["symbol", "month"], "left").select("symbol", "ts", sig.alias("signal"))


def _mean_free(laid: Laid) -> DataFrame:
    """laid.df and `_x`, the close less its mean over the symbol."""
    mean = laid.df.groupBy("symbol", "chunk").agg(F.sum("close").alias("_s"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("symbol")  # one row per chunk
    mean = mean.select("symbol", "chunk", (F.sum("_s").over(whole) / F.sum("_n").over(whole)).alias("_mean"))
    return laid.df.join(mean, ["symbol", "chunk"]).withColumn("_x", F.col("close") - F.col("_mean"))


def dominant_period(laid: Laid, periods: list[int]) -> DataFrame:
    """Which of some periods has the largest power of the mean-free close, per symbol: one wide aggregate, combined map-side."""
    x = _mean_free(laid)
    angle = lambda p: F.pmod("seq", F.lit(p)) * (2 * math.pi / p)
    sums = [F.sum(F.col("_x") * fn(angle(p))).alias(f"{n}{p}") for p in periods for n, fn in (("c", F.cos), ("s", F.sin))]
    row = x.groupBy("symbol").agg(*sums)
    power = F.array(*[F.struct((F.col(f"c{p}") ** 2 + F.col(f"s{p}") ** 2).alias("power"), F.lit(-p).alias("p")) for p in periods])
    return row.select("symbol", (-F.array_max(power)["p"]).alias("period"))


def spectral_period(laid: Laid, cells: int | None = None) -> DataFrame:
    """Bars / k, rounded, of the strongest Fourier bin k = 1 .. bars / 2 of the mean-free close, per symbol (the least such k).

    Groups of the transform hold as many values as a chunk, or `cells`.  A symbol of one bar has no period."""
    bins = power_spectrum(_mean_free(laid).select("symbol", "seq", "bars", F.col("_x").alias("x")), cells or laid.rows)
    best = bins.groupBy("symbol", "bars").agg(F.max(F.struct("power", (-F.col("k")).alias("k"))).alias("best"))
    return best.select("symbol", F.rint(F.col("bars") / -F.col("best.k")).cast("int").alias("period"))


def cycle_signals(laid: Laid, periods=None, threshold: float = 0.5, turning: bool = False) -> DataFrame:
    """A sine of the dominant period, less its mean, crossing the threshold up (long) or its negative down (short).

    The period is that of the strongest bin of the whole spectrum, or the strongest of `periods`.  The sine is taken of
    one turn spread over the whole series, times 2 pi / period; with `turning` it turns once in every period instead."""
    best = dominant_period(laid, list(periods)) if periods else spectral_period(laid)
    keys = laid.df.select("symbol", "chunk").distinct().join(best, "symbol", "left")  # one row per chunk
    d = laid.df.select("symbol", "chunk", "seq", "bars", "ts").join(keys, ["symbol", "chunk"])
    if turning:
        wave = lambda k: F.sin(F.pmod(F.col("seq") - k, F.col("period")) * (2 * math.pi) / F.col("period"))
    else:
        wave = lambda k: F.sin((F.col("seq") - k) * (2 * math.pi) / (F.col("bars") - 1) * (2 * math.pi / F.col("period")))
    part = d.groupBy("symbol", "chunk").agg(F.sum(wave(0)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("symbol")  # one row per chunk
    part = part.select("symbol", "chunk", (F.sum("_s").over(whole) / F.sum("_n").over(whole)).alias("_mean"))
    d = d.join(part, ["symbol", "chunk"])
    now, before = wave(0) - F.col("_mean"), wave(1) - F.col("_mean")
    up = (F.col("seq") > 0) & (now > threshold) & (before <= threshold)
    down = (F.col("seq") > 0) & (now < -threshold) & (before >= -threshold)
    return d.select("symbol", "ts", "period", F.when(up, 1).when(down, -1).otherwise(0).alias("signal"))
