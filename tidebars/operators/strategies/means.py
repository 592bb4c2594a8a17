"""Rules on moving averages: states, crosses, exponential means, regressions."""

from __future__ import annotations

from tidebars.functions.expr import (
    C, H, L, O, V, absx, coalesce, cross_dn, cross_up, diff, ema, ema_alpha, greatest, lag, lead, least, logx, pct, rmax, rmin,
    roll, rstd, rsum, run, signal, sma, SEQ, true, when, wma,
)
from tidebars.operators import indicators as I


def state(a, b):
    return signal(a > b, a < b)


def event(a, b):
    """First bar of each side."""
    st = true(a > b)
    return signal(st & ~lag(st), ~st & lag(st))


def two_means(short, long_, make, partial=False):
    need = 1 if partial else None
    return make(sma(C, short, need), sma(C, long_, need))


def crossing(a, b):
    return signal(cross_up(a, b), cross_dn(a, b))


# rule names by (short length, long length)
EVENTS = {
    (50, 200): """3_free_mean_reversion donchian_channels gold_weekend golden_ma internal_bar_strength_in_consumer_staples
        moving_average shorting_oil_when_dollar_rises trading_audusd_strategy_for_the_aussie_forex_currency_pair
        trading_strategies_for_french_stocks_ewq what_are_quantified which_oscillating_indicator_is_the_best_for""",
    (20, 50): """5_consecutive_higher_opens china energy_sector real_estate what_happens_after_an_extraordinary_big_fall_in_sp
        what_returns_can_we_expect_after_a_very_bad_friday_in_the_stock_market""",
    (5, 20): "audjpy_forex audnzd_forex chf_jpy gbp_cad intraday leveraged_etf usd_cad",
    (10, 30): "bond copper end_of_the_year_santa_claus_rally weekend_trend_trader",
    (10, 50): "cadjpy_forex rsi2_on_qqq_nasdaq",
    (14, 28): "eurjpy",
    (14, 50): "nzd_cad orange_juice",
}
PARTIAL_EVENTS = {
    (50, 200): """buy_and_hold buy_when_sp_500_makes_new_intraday_high does_volume_really_matter_in_spy growth_stock
        how_i_made_an_rsi_trading_strategy_using_python keltner_bands monday_tuesday_trade_in_nasdaq_update sugar_futures
        trade_the_boring_consumer_stocks_when_they_open_down_and_yesterday_was_a_down_day ways_to_use_adx""",
    (5, 20): "coffee heating_oil_futures",
    (3, 10): "e_mini",
    (10, 30): "sp_500_and_gold_rotation_strategy_spy_and_gld_rotation",
    (10, 50): "us_dollar",
}
STATES = {
    (50, 200): "breakout_2 cta does_the_macd_indicator_work exponential_moving_average golden_cross",
    (14, 50): "cocoa",
    (10, 30): """cotton etf_sector_rotation gbp_nzd hard_red_winter_wheat_futures quality_factor
        stock_trading_should_you_use_a_stop_loss these_are_the_best_trading_days_for_stocks
        what_trading_hour_is_the_best_for_gold_oil_silver_sp500_and_swiss_franc when_to_sell_unveiling_the_best_trade_exits""",
    (14, 28): "end_of_bear_market",
    (5, 20): "eurnzd_forex gbpusd should_you_trade_or_invest",
    (10, 50): "four_up_days_in_row_sp_500",
    (20, 50): "sector_rotating_between_sp_500_and_treasuries technology_sector",
}
PARTIAL_STATES = {
    (20, 50): "financial_services_sector the_greatest_gold_stock_system_you_should_trade_what_happened",
    (50, 200): "pivot_points_is_it_profitable",
}
# close against one mean
LEVELS = {
    200: "200_day_moving_average_2 market_timing",
    20: "a_fine_example_of_an_overnight australian crypto_seasonality day_of_week_bull_or_bear_market how_to_trade_the_end_of_month_bias_in_stocks",
    10: "trend_following_treasuries",
}
LEVELS_REVERSED = {20: "best_inverse_etf why_trade_xlu_and_utility_stocks"}
CROSSINGS = {20: "cryptocurrency trade_during_a_recession", 8: "eight_month_avg", 200: "trend_following_system_sp_500"}


def _spread(table, build):
    return {name: build(key) for key, names in table.items() for name in names.split()}


def families():
    xov = {
        **_spread(EVENTS, lambda k: two_means(*k, event)),
        **_spread(PARTIAL_EVENTS, lambda k: two_means(*k, event, True)),
    }
    xma = {
        **_spread(STATES, lambda k: two_means(*k, state)),
        **_spread(PARTIAL_STATES, lambda k: two_means(*k, state, True)),
    }
    s5, s8, s13 = (sma(C, n) for n in (5, 8, 13))
    xma["strategy_5_8_13"] = signal((s5 > s8) & (s8 > s13), (s5 < s8) & (s8 < s13))
    mid15 = (rmax(H, 15) + rmin(L, 15)) / 2.0
    xma["mhlma"] = state(sma(C, 50), sma(mid15, 50))

    s20 = sma(C, 20)
    lvl = {
        **_spread(LEVELS, lambda n: state(C, sma(C, n))),
        **_spread(LEVELS_REVERSED, lambda n: state(sma(C, n), C)),
        **_spread(CROSSINGS, lambda n: crossing(C, sma(C, n))),
        "big_reversal_moves": state(C, sma(C, 50)),
        "displaced_moving_average": crossing(C, lead(s20, 5)),
        "dual_momentum": signal((C > lag(sma(C, 6))) & (C > lag(sma(C, 12))), (C < lag(sma(C, 6))) & (C < lag(sma(C, 12)))),
        "micro_e_mini_sp_500_index": signal(C > s20 * 1.02, C < s20 * 0.98),
        "moving_average_envelope": signal(C < s20 * 0.95, C > s20 * 1.05),
        "moving_average_2": state(C, sma(C, 15)),
        "spy_small_caps_rotation_system": state(sma(C, 30), 100.0),
        "swingthree": signal(
            (H > sma(H, 14) + 5.0) & (lag(C) > lag(ema(C, 50))), (L < sma(L, 14) - 5.0) & (lag(C) < lag(ema(C, 50)))),
        "the_options_expiration_week_opex_of_october": signal(C > s20 * 1.05, C < s20 * 0.95),
        "trend_following": signal(C > sma(C, 10) * 1.03, C < sma(C, 10) * 0.97),
        "simple_trend_channel": signal(
            (C > sma(H, 8)) & (s20 > sma(C, 50)), (C < sma(L, 8)) & (s20 < sma(C, 50))),
        "vix_timing": signal(
            roll("sum", when(true(C < sma(C, 14)), 1.0, otherwise=0.0), 14).eq(14.0) & ~true(lag(C, 14) < lag(sma(C, 14), 14)),
            roll("sum", when(true(C > sma(C, 14)), 1.0, otherwise=0.0), 14).eq(14.0) & ~true(lag(C, 14) > lag(sma(C, 14), 14))),
    }

    e20 = ema(C, 20)
    line, sig, hist = I.macd()
    pl, ps, _ = I.ppo()
    e12, e26 = ema(C, 12), ema(C, 26)
    ha = (lag(O) + lag(C)) / 2.0
    ha_close = (O + H + L + C) / 4.0
    ha_mean = (ha + greatest(H, ha, ha_close) + least(L, ha, ha_close) + ha_close) / 4.0
    rate = ema_alpha(ema_alpha(coalesce(pct(C), 0.0) * 100.0, 2.0 / 20) * 10.0, 2.0 / 10)
    emax = {
        "20_ema": crossing(C, e20),
        "9_ema": crossing(C, ema(C, 9)),
        "average_true_range_trading_strategy_atr_indicator": crossing(line, sig),
        "ema": crossing(e12, e26),
        "macd_histogram": crossing(hist, 0.0),
        "macd": crossing(line, sig),
        "macd_2": signal((line > sig) & (lag(line) < lag(sig)), (line < sig) & (lag(line) > lag(sig))),
        "macd_signals_registry": state(line, sig),
        "mov_avg_two_lines": crossing(ema(C, 5), e20),
        "percentage_price_oscillator": crossing(pl, ps),
        "ppo": crossing(pl, ps),
        "pmo": crossing(rate, ema(rate, 10)),
        "python_and_macd": state(hist, 0.0),
        "simple_moving_average": crossing(line, 0.0),
        "sve_ha_typ_cross": crossing(ema(I.TYP, 14), ema(ha_mean, 14)),
        "swiss_franc": crossing(line, sig),
        "trend_following_and_momentum_on_bitcoin": state(C, e20),
        "sentiment_zone": signal(
            (rmax(C, 14) - C < C - rmin(C, 14)) & (C > sma(C, 30)) & (ema(C, 60) > lag(ema(C, 60))),
            (rmax(C, 14) - C > C - rmin(C, 14)) & (C < sma(C, 30)) & (ema(C, 60) < lag(ema(C, 60)))),
    }

    laguerre = ema_alpha(lag(C), 0.5)
    stoch_ehlers = I.high_pass(C, 10) - I.high_pass(C, 20)
    up = stoch_ehlers > lag(stoch_ehlers)
    k10, k20 = I.kama(C, 10), I.kama(C, 20)
    hl3, ohlc4 = sma(I.TYP, 14), sma(ha_mean, 14)
    ratio = ema(C, 9) * 100.0 / I.t3(C, 14)
    uni = I.universal_oscillator(C, 20)
    fr = I.frama(20)
    filters = {
        "adaptive_laguerre_filter": state(C, laguerre),
        "ehlers_stoch": signal(up & ~lag(up), ~up & lag(up)),
        "hacolt": signal(ratio >= 100.0, ratio <= 0.0),
        "kama_cross": crossing(k10, k20),
        "supersmoother": state(C, I.supersmoother(C, 10)),
        "svesc": signal(hl3 > ohlc4, hl3 < ohlc4),
        "universal_oscillator_strategy": signal(cross_dn(uni, 0.0), cross_up(uni, 0.0)),
        "frama": signal(C > fr + I.atr0(14) * 1.9, C < fr - I.atr0(14) * 1.9),
    }

    g = [2.718281828459045 ** (-0.5 * ((i - 6.5) / 1.0) ** 2) for i in range(14)]
    gauss = sum((lag(C, i) * (w / sum(g)) for i, w in enumerate(g) if w > 1e-12), start=C * 0.0)
    w5, w8, w13 = (wma(C, n) for n in (5, 8, 13))
    r39, r6 = wma(coalesce(pct(C), 0.0), 39), wma(coalesce(pct(C), 0.0), 6)
    weights = {
        "gaussian_filter": state(gauss, lag(gauss)),
        "golden_wma": crossing(wma(C, 50), wma(C, 200)),
        "short_wma": crossing(wma(C, 13), wma(C, 26)),
        "strategy_w5_8_13": signal((w5 > w8) & (w8 > w13), (w5 < w8) & (w8 < w13)),
        "reverse_ema": state(r39, 0.0),
        "reverse_ema_strat": signal((r39 > 0.0) & (r6 > 0.0), (r39 < 0.0) & (r6 < 0.0)),
    }

    fit = lambda fn, n, x=C: roll(fn, x, n, y=SEQ)
    end14 = fit("regr_intercept", 14) + fit("regr_slope", 14) * SEQ
    line21 = fit("regr_intercept", 21) + fit("regr_slope", 21) * SEQ
    err21 = rstd(C - line21, 21)
    r2, slope18 = fit("regr_r2", 18), fit("regr_slope", 18)
    logs = [logx(rstd(diff(C, k), 20)) for k in (2, 4, 8, 16)]
    xs = [0.6931471805599453 * k for k in (1, 2, 3, 4)]
    xm = sum(xs) / 4
    ym = (logs[0] + logs[1] + logs[2] + logs[3]) / 4.0
    hurst = sum(((y - ym) * ((x - xm) / sum((v - xm) ** 2 for v in xs)) for x, y in zip(xs, logs)), start=C * 0.0)
    k14 = I.stoch_k(14)
    agree = lambda n, sign: (fit("regr_slope", n) * sign > 0.0) & (roll("regr_slope", k14, n, y=SEQ) * sign < 0.0)
    reg = {
        "hurst_exponent": state(hurst, 0.5),
        "linear_regression_indicator": state(C, end14),
        "standard_error_bands": signal(C < sma(line21 - err21 * 2.0, 3), C > sma(line21 + err21 * 2.0, 3)),
        "r2trend": signal(
            (r2 > 0.85) & (r2 > lag(r2, 10)) & (slope18 > 10.0) & (C > sma(C, 50)),
            (r2 > 0.85) & (r2 > lag(r2, 10)) & (slope18 < -10.0) & (C < sma(C, 50))),
        "get_three_period_divergence": signal(
            agree(5, -1.0) & agree(10, -1.0) & agree(15, -1.0), agree(5, 1.0) & agree(10, 1.0) & agree(15, 1.0)),
        "calculate_slope": state(slope18, 0.0),
        "calculate_rsquared": signal(r2 > 0.85),
    }

    m = I.directional(14)
    adx = m["adx"]
    strong = ((adx > rmin(adx, 14, 1) * 2.0) & (adx > 20.0)) | ((adx > 25.0) & (adx < 50.0))
    eh, el, ec = ema(H, 14), ema(L, 14), ema(C, 14)
    pzo = (ec - (eh + el) / 2.0) * 100.0 / (eh - el)
    e60 = ema(C, 60)
    ub, mb, lb = I.bollinger(14)
    pb = (C - mb) * 100.0 / ((ub - lb) / 2.0)
    z = I.zscore(14) * 100.0
    vpt = run("sum", coalesce(pct(C), 0.0) * V)
    x40 = (vpt > 40.0) & (lag(vpt) < 40.0)
    x0 = (vpt > 0.0) & (lag(vpt) < 0.0)
    fall5 = (vpt < -5.0) & (lag(vpt) > -5.0)
    trending = adx > 18.0
    back60 = (pzo > -60.0) & (lag(pzo) <= -60.0)
    directional = {
        "adxtrend": signal(strong & (C > sma(C, 14)), strong & (C < sma(C, 14))),
        "adx_breakouts": signal((adx > 40.0) & (C > roll("max", H, 15, hi=-1) + 0.5)),
        "calculate_pzo": signal(pzo > 40.0, pzo < -40.0),
        "pricezoneoscillatorsx": signal(
            (trending & (back60 | ((pzo > 0.0) & (C > e60))))
            | ((adx < 18.0) & (back60 | (((pzo > 0.0) | (lag(pzo) > -40.0)) & (C > e60))
                              | ((pzo > 15.0) & (lag(pzo) <= -5.0) & (lag(pzo, 2) > -40.0))))),
        "pzo_lx": signal(
            C.ne(C),
            (trending & (pb > 60.0) & (pb < lag(pb))) | (trending & (C < e60) & (pb < 0.0))
            | ((adx < 18.0) & (lag(pb) > 40.0) & (pb < 0.0) & (C < e60)) | ((adx < 18.0) & (lag(pb) < 15.0) & (pb > -5.0) & (pb < 40.0))),
        "pzo": signal(
            (trending & (C > ema(C, 60, "adjusted")) & (((lag(z) < -40.0) & (z > -40.0)) | ((lag(z) < 0.0) & (z > 15.0))))
            | ((adx <= 18.0) & (((lag(z) < -40.0) & (z > -40.0)) | ((lag(z) < 15.0) & (z > 15.0))))),
        "pzo_trend": signal(
            C.ne(C), (trending & (C < e60) & (x40 | (x0 & fall5))) | ((adx < 18.0) & (x40 | fall5))),
        "rsi_adx": signal((I.rsi(14) < 30.0) & (adx > 20.0), (I.rsi(14) > 70.0) & (adx > 20.0)),
    }

    peak = (C > lag(C)) & (C > lead(C))
    rolling = rsum(V, 30)
    busy = rolling * 5.0 / roll("percentile", rolling, 300, p=0.95) > 2.0
    hi_pivot, lo_pivot = H.eq(roll("max", H, 31, hi=15)), L.eq(roll("min", L, 31, hi=15))
    fh, fl = H.eq(roll("max", H, 5, hi=2)), L.eq(roll("min", L, 5, hi=2))
    e10, e100 = ema(C, 10), ema(C, 100)
    swing = pct(C)
    ext_hi, ext_lo = C.eq(roll("max", C, 5, hi=2)), C.eq(roll("min", C, 5, hi=2))
    zig_hi, zig_lo = ext_hi & (absx(swing) > 0.05), ext_lo & (absx(swing) > 0.05)
    pivots = {
        "day_trading_price_action": signal((L < lag(L)) & (L < lead(L)), (H > lag(H)) & (H > lead(H))),
        "fractal_chaos_bands": signal(C > roll("max", lag(H, 3), 5), C < roll("min", lag(L, 3), 5)),
        "golden_triangle": signal(
            true(lag((C > sma(C, 50)) & peak)) & true(lag((C > sma(C, 20)) & (V > roll("max", V, 5, hi=-1))))),
        "high_volume_points": signal(lo_pivot & busy, hi_pivot & busy),
        "high_volume_points_liquidity_grab": signal(
            lo_pivot & busy & (C > lag(when(true(lo_pivot), L))), hi_pivot & busy & (C < lag(when(true(hi_pivot), H)))),
        "fractal_ema": signal(fl & (e10 > e20) & (e20 > e100), fh & (e10 < e20) & (e20 < e100)),
        "calculate_zigzag": signal(zig_lo, zig_hi),
        "rsi_trend": signal((I.rsi(14) < 30.0) & zig_lo, (I.rsi(14) > 70.0) & zig_hi),
    }
    return {
        "two_mean_events": xov, "two_mean_states": xma, "mean_levels": lvl, "exponential_crosses": emax,
        "recursive_filters": filters, "weighted_means": weights, "regressions": reg, "directional_movement": directional,
        "pivots": pivots,
    }
