"""Joins of several symbols on time, as-of joins, and the rules built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.expr import (
    C, H, L, SEQ, V, absx, coalesce, col, cross_dn, cross_up, diff, ema, glob, greatest, known, lag, lead, logx, month, pct, rmax, rmin,
    roll, rstd, rsum, run, signal, sma, true, when,
)
from tidebars.operators import indicators as I
from tidebars.operators.strategies.means import crossing, state


# --- plans ------------------------------------------------------------------------
def panel(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """One row per time on which every listed symbol has a bar: the first symbol's
    bar plus ``close_2 .. close_n``.  One shuffle by time, combined map-side."""
    is_ = lambda s: F.col("symbol") == s
    aggs = [F.max(F.when(is_(symbols[0]), F.col(c))).alias(c) for c in ("open", "high", "low", "close", "volume")]
    aggs += [F.max(F.when(is_(s), F.col("close"))).alias(f"close_{i}") for i, s in enumerate(symbols[1:], 2)]
    wide = bars.filter(F.col("symbol").isin(symbols)).groupBy("ts").agg(*aggs)
    names = ["close"] + [f"close_{i}" for i in range(2, len(symbols) + 1)]
    return wide.na.drop(subset=names).select(F.lit("/".join(symbols)).alias("symbol"), "*")


def pair_bars(bars: DataFrame, first: str, second: str) -> DataFrame:
    """Bars of two symbols joined on equal times."""
    a = bars.filter(F.col("symbol") == first).select("ts", F.col("close").alias("close_a"), F.col("volume").alias("volume_a"))
    b = bars.filter(F.col("symbol") == second).select("ts", F.col("close").alias("close_b"), F.col("volume").alias("volume_b"))
    return a.join(b, "ts")


def unmatched_times(bars: DataFrame, first: str, second: str) -> DataFrame:
    """How many times each of two symbols has that the other lacks."""
    hit = bars.filter(F.col("symbol").isin(first, second)).groupBy("ts").agg(
        F.max((F.col("symbol") == first).cast("int")).alias("a"), F.max((F.col("symbol") == second).cast("int")).alias("b")
    )
    return hit.agg(
        F.sum(F.when((F.col("a") == 1) & (F.col("b") == 0), 1).otherwise(0)).alias("only_first"),
        F.sum(F.when((F.col("a") == 0) & (F.col("b") == 1), 1).otherwise(0)).alias("only_second"),
        F.sum(F.when((F.col("a") == 1) & (F.col("b") == 1), 1).otherwise(0)).alias("matched"),
    )


def asof_join(bars: DataFrame, ref: DataFrame, values: list[str], unit: str = "day") -> DataFrame:
    """Latest reference row at or before each bar.

    The reference (``ts`` unique, slowly changing) becomes validity intervals,
    spread over the calendar units they touch; bars then meet at most the few
    intervals of their own unit in an equi-join keyed by time, never by symbol.
    A small reference is broadcast by the optimizer from its measured size.
    """
    w = Window.orderBy("ts")  # the reference only: one row per change
    spans = ref.select("ts", *values).withColumn("_until", F.lead("ts").over(w))
    last = bars.agg(F.max("ts").alias("_max"))
    spans = spans.crossJoin(F.broadcast(last)).select(  # one row
        F.col("ts").alias("_from"), "_until", *values,
        F.explode(F.expr(
            f"sequence(date_trunc('{unit}', ts), date_trunc('{unit}', greatest(ts, coalesce(_until, _max))), interval 1 {unit})"
        )).alias("_unit"),
    )
    b = bars.withColumn("_unit", F.date_trunc(unit, "ts"))
    hit = (F.col("b._unit") == F.col("r._unit")) & (F.col("b.ts") >= F.col("r._from")) & (
        F.col("r._until").isNull() | (F.col("b.ts") < F.col("r._until")))
    return b.alias("b").join(spans.alias("r"), hit, "left").select(*[f"b.{c}" for c in bars.columns], *[f"r.{v}" for v in values])


def in_favourites(bars: DataFrame, favourites: DataFrame) -> DataFrame:
    """Bars of listed symbols only (semi join)."""
    return bars.join(favourites.select("symbol").distinct(), "symbol", "left_semi")


def short_favourites(bars: DataFrame, favourites: DataFrame) -> DataFrame:
    """Red bar of a favourite symbol: short."""
    return in_favourites(bars, favourites).select(
        "symbol", "ts", F.when(F.col("close") < F.col("open"), -1).otherwise(0).alias("signal"))


def merge_signals(parts: list[DataFrame]) -> DataFrame:
    """Long union of (symbol, ts, strategy, signal) tables; the last non-null wins."""
    rows = None
    for i, p in enumerate(parts):
        p = p.select("symbol", "ts", "strategy", "signal", F.lit(i).alias("_part"))
        rows = p if rows is None else rows.unionByName(p)
    best = F.max_by("signal", F.when(F.col("signal").isNotNull(), F.col("_part")))
    return rows.groupBy("symbol", "ts", "strategy").agg(best.alias("signal"))


def breadth(bars_with_flag: DataFrame, flag: str) -> DataFrame:
    """How many symbols hold a condition at each time."""
    return bars_with_flag.groupBy("ts").agg(
        F.sum(F.col(flag).cast("int")).cast("long").alias("holding"), F.count(F.lit(1)).alias("symbols"))


def best_asset(returns: DataFrame, value: str) -> DataFrame:
    """Symbol with the largest value at each time; ties go to the last name."""
    best = F.max(F.struct(F.col(value), F.col("symbol"))).alias("m")
    return returns.groupBy("ts").agg(best).select("ts", F.col("m.symbol").alias("symbol"), F.col(f"m.{value}").alias(value))


# --- rules over a panel --------------------------------------------------------------
C2, C3, C4, C5, C6 = (col(f"close_{i}") for i in range(2, 7))
SIX_ASSET_WEIGHTS = (0.30, 0.15, 0.05, 0.15, 0.15, 0.20)


def panel_rules() -> dict:
    closes = [C, C2, C3, C4, C5, C6]
    r = [pct(x) for x in closes]
    cum = [x / run("first", x) for x in closes]
    best = greatest(*cum)
    ts = col("ts")
    month_end = lead(month(ts)).ne(month(ts))
    swensen = sum((x * w for x, w in zip(r[1:], SIX_ASSET_WEIGHTS[1:])), start=r[0] * SIX_ASSET_WEIGHTS[0])
    over200 = sum((when(true(x > sma(x, 200)), 1, otherwise=0) for x in closes[1:5]), start=when(true(C > sma(C, 200)), 1, otherwise=0))
    beta = roll("covar_samp", r[0], 60, y=r[1]) / roll("var_samp", r[1], 60)
    dalio = sma(r[0] * 0.3 + r[1] * 0.55 + r[2] * 0.15, 30)
    rsi_a, rsi_b = I.rsi(5), I.rsi(5, C2)
    ratio = C / C2
    rising = lambda x: sma(x, 12) > lag(sma(x, 12))
    falling = lambda x: sma(x, 12) < lag(sma(x, 12))
    sixty = r[0] * 0.6 + r[1] * 0.4
    rsc = pct(C, 14) / pct(C2, 14)
    new_month = SEQ.eq(0) | month(ts).ne(month(lag(ts)))

    def month_return(x):
        m1 = run("last", when(new_month, lag(x)))
        m2 = run("last", when(new_month, lag(m1)))
        return m1 / m2 - 1.0

    x0, y0 = known(coalesce(r[0], 0.0), 0), known(coalesce(r[1], 0.0), 0)
    cov = glob("avg", x0 * y0) - glob("avg", x0) * glob("avg", y0)
    corr_all = cov / (glob("stddev_pop", x0) * glob("stddev_pop", y0))
    s13, s25 = sma(ratio, 13), sma(ratio, 25)
    div25 = roll("corr", r[0], 25, y=r[1])
    corr3 = roll("corr", pct(C, 10), 20, y=pct(C3, 10))
    slope = C - lag(C, 25) - (C2 - lag(C2, 25))
    rs = ema(known(coalesce(logx(ratio / lag(ratio, 10)), 0.0), 0), 10)
    stress = (C - rmin(C, 14)) * 100.0 / (rmax(C, 14) - rmin(C, 14))
    unstressed = (stress > 70.0) | (C < lag(C) * 0.95) | (rmin(C, 14) < C * 0.9)
    flag = lambda c, w: when(true(c), w, otherwise=0.0)
    score = (
        flag(rsum(when(C > lag(C), V, C < lag(C), -V, otherwise=0.0), 14) > 0.0, 1.0) + flag(C > sma(C, 14), 1.0)
        + flag(sma(C, 14) > lag(sma(C, 14)), 1.0) + flag(I.efficiency(C, 10) > 0.3, 1.0) + flag(C2 > sma(C2, 14), 2.0))
    stock_vol, sector_vol = rstd(r[0], 20), rstd(r[1], 20)
    return {
        "60_40_portfolio": coalesce(run("last", when(sixty > 0.0, 1, sixty < 0.0, -1)), 0),
        "a_monthly_momentum_strategy_in_etfs": when(*[p for i, x in enumerate(cum[:-1]) for p in (x.eq(best), i + 1)], otherwise=6),
        "a_pair_trade_in_spy_and_tlt": signal((r[0] < -0.015) & (r[1] > 0.015)),
        "bond_move_index_tlt": when(C2 <= glob("avg", C2) + glob("stddev_samp", C2) * 2.0, 1, otherwise=-1),
        "carry_trade": state(r[0] - r[1], 0.0),
        "copper_vs_stocks": signal((C > sma(C, 5)) & (r[0] > 0.0) & (r[1] > 0.0), (C < sma(C, 5)) & (r[0] < 0.0) & (r[1] < 0.0)),
        "david_swensen_portfolio": state(swensen, 0.0),
        "fabian_timing_model": signal(
            (C > sma(C, 39)) & (C2 > sma(C2, 39)) & (C3 > sma(C3, 39)), (C < sma(C, 39)) & (C2 < sma(C2, 39)) & (C3 < sma(C3, 39))),
        "get_rich_portfolio": signal(sum(r[1:], start=r[0]) / 6.0 > 0.015, sum(r[1:], start=r[0]) / 6.0 < -0.01),
        "gold_silver_chart_ratio": signal(rsi_a > 75.0, (rsi_a < 50.0) | (rsi_b < 50.0)),
        "how_does_the_sp_500_perform_when_interest_rates_are_rising": state(sma(C, 200), C2),
        "larry_swedroe_portfolio_30_70_small_cap_value": signal(
            rising(C) & rising(C2) & rising(C3), falling(C) & falling(C2) & falling(C3)),
        "low_volatility_stocks": when(true(beta < 1.0), 1, otherwise=-1),
        "lumber_gold_ratio_trading_strategy_for_stocks_and_bonds": state(ratio, 0.5),
        "market_neutral": state(cum[0], cum[1]),
        "meb_faber_tactical_asset_allocation": when(over200.eq(5), 1, over200.eq(0), -1, otherwise=0),
        "pentad_timing_model": signal(
            (r[0] > 0.0) & (r[1] > 0.0) & (r[2] > 0.0) & (r[3] > 0.0), (r[0] < 0.0) | (r[1] < 0.0) | (r[2] < 0.0) | (r[3] < 0.0)),
        "ray_dalios_all_weather_portfolio": signal(month_end & (dalio > 0.0), month_end & (dalio < 0.0)),
        "relative_strength_comparative": crossing(rsc, 1.0),
        "rotating_system_sp500_and_utilities": state(pct(C, 5), pct(C2, 5)),
        "spy_tlt_bond_rotation": state(month_return(C), month_return(C2)),
        "stock_market_price_factors": signal((sma(r[1], 5) > 0.0) & (sma(r[2], 5) > 0.0), (sma(r[1], 5) < 0.0) & (sma(r[2], 5) < 0.0)),
        "stock_vs_bond_investment": signal(r[0] > 0.05, r[1] > 0.03),
        "using_vix_to_trade_spy_and_sp_500": signal((C2 > sma(C2, 20) + rstd(C2, 20) * 2.0) & (r[0] > 0.0) & (lag(r[0]) > 0.0)),
        "xlk_xlu_ratio": state(ratio, sma(ratio, 200)),
        "calculate_sector_realized_volatility": state(stock_vol, sector_vol),
        "multi_currency_correlation": signal(corr_all * 100.0 > 50.0, corr_all * 100.0 < -50.0),
        "pair_trading_long": crossing(s13, s25),
        "pair_trading_long_reversion": crossing(s13, ratio),
        "pair_trading_long_pullback": signal((s13 < ratio) & (ratio < s25), (s13 > ratio) & (ratio > s25)),
        "pair_trading_short": crossing(s25, s13),
        "pair_trading_short_reversion": crossing(ratio, s13),
        "pair_trading_short_pullback": signal(cross_up(ratio, s13) & (ratio < s25), cross_dn(ratio, s13) & (ratio > s25)),
        "calculate_price_ratio": state(ratio, 1.0),
        "calculate_divergence": signal(div25 > 0.5, div25 < -0.5),
        "calculate_corr3": signal(corr3 > 0.5, corr3 < -0.5),
        "regression_divergence_strat": signal(cross_dn(slope, 0.0) & (corr3 > 0.0), cross_up(slope, 0.0) & (corr3 > 0.0)),
        "rsmk": signal(cross_up(rs, 0.0)),
        "stress": when(true(unstressed), -1, true((stress < 30.0) & (sma(C2, 14) > lag(sma(C2, 14)))), 1, otherwise=0),
        "technicalstockratingstrat": signal(score >= 5.0),
    }


# --- rules on external columns ----------------------------------------------------------
def external_rules() -> dict:
    """Rules on reference columns joined as of each bar."""
    pmi, conf, conf3, expo = col("pmi"), col("confidence"), col("confidence_mean3"), col("exposure")
    bull, bear, rate, rate_prev = col("bullish"), col("bearish"), col("rate"), col("rate_prev")
    risk, infl, sent = col("risk"), col("inflation"), col("sentiment")
    spread = bull - bear
    change30 = sma(pct(C), 30)
    entry, add = glob("first_value", C), glob("first_value", C) * 0.95
    return {
        "aaii_and_market_sentiment_indicators": signal(spread < -30.0, spread > 60.0),
        "averaging_down": state(C, (entry + add) / 2.0),
        "bottom_timing": state(sent + spread / 100.0, 0.0),
        "consumer_confidence": state(conf, conf3),
        "deflation": when(true(change30 < 0.0), -1, rate < 1.5, 1, otherwise=0),
        "does_rsi_work_on_crypto_or_bitcoin": signal(sent > 0.5, sent < -0.5),
        "ism_manufacturing_index_pmi": state(pmi, 50.0),
        "macro": signal((C > lag(C)) & (rate < rate_prev) & (infl < 3.0), (C < lag(C)) & (risk > 5.0)),
        "naaim": signal(expo < 40.0, expo > 60.0),
        "trin": signal((V / sma(V, 20)) / (bull / (bear + 1.0)) < 1.0, (V / sma(V, 20)) / (bull / (bear + 1.0)) > 1.0),
        "calculate_vol_score": signal(rstd(pct(C), 20) > rate / 10.0),
    }


# --- fundamental screens -----------------------------------------------------------------
# fixed values: markets of the country screen
TOP_MARKETS = ["Australia", "United States", "South Africa", "New Zealand", "Denmark"]


def growth_screen(df: DataFrame) -> DataFrame:
    """Seven fundamental predicates at once; quarterly growth is a four-row mean per symbol."""
    w = Window.partitionBy("symbol").orderBy("period").rowsBetween(-3, 0)
    ok = (
        (F.col("eps_growth_qtr_mean") > 25) & (F.col("eps_growth_ann") >= 25) & (F.col("new_product") == 1)
        & (F.col("price_strength") >= 1.5) & (F.col("relative_strength") >= 70) & (F.col("institutional") > 0.5)
        & (F.col("market_trend") == "Bull"))
    full = F.count("eps_growth_qtr").over(w) == 4
    return df.withColumn("eps_growth_qtr_mean", F.when(full, F.avg("eps_growth_qtr").over(w))).withColumn(
        "signal", F.when(F.coalesce(ok, F.lit(False)), 1).otherwise(0))


def market_screen(df: DataFrame, markets=None) -> DataFrame:
    listed = F.col("country").isin(list(markets or TOP_MARKETS))
    return df.withColumn("signal", F.when(listed & (F.col("annual_return") > 6.5), 1).when(listed, -1).otherwise(0))


def value_growth_screen(df: DataFrame, value_below=0.2, growth_above=0.15) -> DataFrame:
    hit = (F.col("pe_ratio") < value_below) | (F.col("growth_rate") > growth_above)
    return df.withColumn("signal", F.when(hit, 1).otherwise(-1))


def ten_bagger_screen(df: DataFrame) -> DataFrame:
    cheap = F.try_divide(F.col("close"), F.col("earnings")) < 15
    hit = (cheap & (F.col("earnings_growth") > 0)) | (F.col("close") >= 10 * F.col("purchase_price"))
    return df.withColumn("signal", F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0))


def top_yield(df: DataFrame, k: int = 10) -> DataFrame:
    """The k highest dividend yields (top-k over one sort column, no full sort)."""
    return df.orderBy(F.col("dividend_yield").desc(), "symbol").limit(k).withColumn("signal", F.lit(1))


def implied_over_realised(df: DataFrame) -> DataFrame:
    """Symbols whose implied volatility exceeds both realised ones."""
    return df.filter((F.col("implied") > F.col("realised")) & (F.col("implied") > F.col("sector_realised")))


def custom_rule(df: DataFrame, long_when, short_when) -> DataFrame:
    """Two caller-supplied predicates (functions of the DataFrame giving Columns)."""
    return df.withColumn(
        "signal", F.when(F.coalesce(long_when(df), F.lit(False)), 1).when(F.coalesce(short_when(df), F.lit(False)), -1).otherwise(0))


def top_per_period(returns: DataFrame, value: str, unit: str, k: int = 10) -> DataFrame:
    """The k largest values of each calendar period.

    A first cut keeps k rows per (period, salt), so a crowded period is never
    ranked in one task; the second ranks at most k rows per salt."""
    key = [F.col(value).desc(), F.col("symbol"), F.col("ts")]
    r = returns.filter(F.col(value).isNotNull()).withColumn("period", F.date_trunc(unit, "ts"))
    r = r.withColumn("_salt", F.pmod(F.xxhash64("symbol", "ts"), F.lit(64)))
    first = Window.partitionBy("period", "_salt").orderBy(*key)
    r = r.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k)
    second = Window.partitionBy("period").orderBy(*key)
    return r.withColumn("place", F.row_number().over(second)).filter(F.col("place") <= k).drop("_salt", "_r")
