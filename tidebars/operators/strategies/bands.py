"""Rules on bands, true range, breakouts, running totals and whole-symbol statistics."""

from __future__ import annotations

import math

from tidebars.functions.expr import (
    C, H, L, O, SEQ, V, absx, coalesce, cross_dn, cross_up, diff, ema, expx, fill0, glob, greatest, known, lag, lead, least, logx,
    month, col, pct, powx, rmax, rmin, roll, rstd, rsum, run, signal, signx, sma, sqrtx, true, when,
)
from tidebars.operators import indicators as I
from tidebars.operators.strategies.means import crossing, state


def outside(x, up, low):
    """Reversal: below the lower band long, above the upper band short."""
    return signal(x < low, x > up)


def breakout(x, up, low):
    return signal(x > up, x < low)


def prior_high(n, x=H):
    return roll("max", x, n, hi=-1)


def prior_low(n, x=L):
    return roll("min", x, n, hi=-1)


# close against the range of the n bars before (the current bar is left out)
PRIOR_RANGE = {
    7: "larry_connors_double_seven_strategy_does_it_still_work",
    3: "larry_connors_3_day_high_low_method",
    5: "weekly",
    14: "trend_reversal",
    20: "the_internal_bar_strength_ibs_indicator donchian_channel_strategy",
}


def families():
    ub, mb, lb = I.bollinger(20)
    us, ms, ls = I.bollinger(20, 2.0, False)
    u1, _, l1 = I.bollinger(20, 1.0, False)
    ub25, mb25, lb25 = I.bollinger(25)
    u10, _, l10 = I.bollinger(10)
    u5, _, l5 = I.bollinger(5)
    width = (ub - lb) * 100.0 / C
    z20 = I.zscore(20)
    ku, _, kl = I.keltner(20, 10, 2.0)
    ku1, _, kl1 = I.keltner(20, 10, 1.0)
    line, sig, _ = I.macd()
    pb5, pb10 = (C - l5) / (u5 - l5), (C - l10) / (u10 - l10)
    k14, d14 = I.stochastic()
    above = when(true(C > ub), 1.0, otherwise=0.0)
    e14 = ema(C, 14)
    roc14 = I.roc(14)
    avg_roc = sma(roc14, 9)
    rms = sqrtx(glob("avg", powx(diff(roc14), 2)))
    stiff = rsum(above, 100)
    bnd = {
        "stiffnessstrat": signal(
            (lag(e14) > lag(e14, 2)) & (lag(e14, 2) > lag(e14, 3)) & (lag(stiff) > 90.0), lag(stiff) < 50.0),
        "bollinger_band_squeeze": signal(
            (ub25 - lb25 < sma(ub25 - lb25, 25)) & (C > lag(ub25)), (ub25 - lb25 < sma(ub25 - lb25, 25)) & (C < lag(lb25))),
        "bollinger_bands_width_indicator": state(width, sma(width, 20)),
        "bollinger_bands_le": signal(C > lag(lb)),
        "bollinger_bands_short_entry": signal(C.ne(C), C < ub),
        "corn_futures": signal(z20 <= -1.0, z20 >= 1.0),
        "how_i_made_a_bollinger_band_strategy_using_chatgpt_backtest": outside(C, us, ls),
        "how_i_used_tradingview_to_create_and_backtest_a_bollinger_band": outside(C, ub, lb),
        "how_to_backtest_a_trading_strategy_using_chatgpt": outside(C, us, ls),
        "keltner_channel": breakout(C, ku, kl),
        "larry_connors_b_strategy_bollinger_band": signal(pb5 < 0.0, pb5 > 1.0),
        "macd_and_bollinger_bands": signal((C > ub) & (line > sig), (C < lb) & (line < sig)),
        "python_bollinger_band": outside(C, us, ls),
        "rocwb": signal((C > ema(C, 12)) & (roc14 > avg_roc - rms * 2.0), (C < ema(C, 12)) & (roc14 < avg_roc + rms * 2.0)),
        "rubber_band": outside(C, ku1, kl1),
        "sve_zl_rb_perc_b_strat": signal((pb10 > lag(pb10)) & (d14 > lag(d14)), (pb10 < lag(pb10)) & (d14 < lag(d14))),
        "the_overnight_edge_is_it_still_working": breakout(C, u1, l1),
        "volatility_band": breakout(C, us, ms - (ms - ls) * 0.5),
        "calculate_realized_volatility": signal(
            rstd(pct(C), 20) * math.sqrt(252.0) > lag(rstd(pct(C), 20), 20) * math.sqrt(252.0)),
    }

    a14, a20 = I.atr0(14), I.atr0(20)
    as14 = I.atr_simple(14)
    mean_atr = glob("avg", as14)
    s100, s10, s30, s5, s20, s14 = (sma(C, n) for n in (100, 10, 30, 5, 20, 14))
    recorded = run("last", when(true(a14.eq(rmax(a14, 14)) & (C > s100)), H))
    stop = lag(C) - lag(a14) * 3.0
    pos10 = (C - rmin(L, 10)) / (rmax(H, 10) - rmin(L, 10))
    kroll_hi, kroll_lo = rmax(H, 10) - a14 * 2.0, rmin(L, 10) + a14 * 2.0
    pgo = (C - s14) / as14
    as21 = I.atr_simple(21)
    atr_rules = {
        "atr_high_sma_breakouts_le": signal(
            (H > lag(recorded) + 0.5) & (C > s100) & (H - L > sma(H - L, 14) * 1.5) & (V > lag(V))),
        "atr_trailing_stop_le": signal((C > stop) & (lag(C) <= lag(stop))),
        "atr_trailing_stop_se": signal(C.ne(C), cross_dn(C, lag(C) - lag(a14))),
        "average_true_range_percentage": signal(as14 * 100.0 / C < 1.5, as14 * 100.0 / C > 1.5),
        "average_true_range_trading_strategy_in_python": signal(
            (as14 > mean_atr * 1.5) & (C > lag(C)), (as14 > mean_atr * 1.5) & (C < lag(C))),
        "chande_kroll_stop": breakout(C, lag(kroll_hi), lag(kroll_lo)),
        "eurcad_forex": signal((s10 > s30) & (as14 > mean_atr), (s10 < s30) & (as14 > mean_atr)),
        "micro_e_mini_nasdaq_100": signal(C > lag(C) + lag(a20) * 1.5, C < lag(C) - lag(a20) * 1.5),
        "overnight_trading_strategy_sp500": signal((C < rmax(H, 10) - I.atr_simple(25)) & (pos10 < 0.5)),
        "pretty_good_oscillator": crossing(pgo, 0.0),
        "stoller_average_range_channels": outside(C, s20 + a20 * 1.5, s20 - a20 * 1.5),
        "trading_brazil": signal((s5 > s20) & (C > s5 + a14), (s5 < s20) & (C < s5 - a14)),
        "volatility": signal(C.ne(C), (C < sma(C, 200)) & (as21 > sma(as21, 21))),
        "volty_expan_close_lx": signal(
            C.ne(C), (L < lag(C) - lag(sma(a14, 14)) * 2.0) & (O < lag(C) - lag(sma(a14, 14)) * 2.0)),
    }

    hi252, lo252 = rmax(C, 252), rmin(C, 252)
    top_c = run("max", C)
    green4 = rsum(when(C > O, 1.0, otherwise=0.0), 4).eq(4.0)
    hi14, lo14 = rmax(C, 14), rmin(C, 14)
    # Of the five levels the lowest one crossed decides.
    crossed = [p for f in (1.0, 0.618, 0.382, 0.236, 0.0) for lev in (hi14 - (hi14 - lo14) * f,)
               for p in (true((lag(C) < lev) & (C >= lev)), 1, true((lag(C) > lev) & (C <= lev)), -1)]
    retraced = when(*crossed, otherwise=0)
    rng7 = rmax(H, 7) - rmin(L, 7)
    conv, base = (rmax(H, 9) + rmin(L, 9)) / 2.0, (rmax(H, 26) + rmin(L, 26)) / 2.0
    rng = H - L
    hi44, lo44 = rmax(H, 44), rmin(L, 44)
    fib_hi, fib_lo = hi44 - (hi44 - lo44) * 0.236, hi44 - (hi44 - lo44) * 0.786
    z40 = I.zscore(40)
    trail = lag(run("max", C)) * 0.99
    below_mean = rsum(when(true(C > sma(C, 200)), 1.0, otherwise=0.0), 18).eq(18.0)
    brk = {name: breakout(C, prior_high(n), prior_low(n)) for n, names in PRIOR_RANGE.items() for name in names.split()}
    brk.update({
        "252_day_high": signal(C >= hi252),
        "252_day_low": signal(C <= lo252),
        "5_day_low_overnight": signal((C < prior_low(5, C)) & (C > O)),
        "52_week_high": signal(C >= hi252 * 0.95, C < hi252 * 0.9),
        "all_time_high": state(C, lag(top_c)),
        "breakout": signal(C > prior_high(20) * 1.05, C < prior_low(20) * 0.95),
        "bull_market_signal": signal(below_mean & (C < top_c * 0.8)),
        "donchian": signal((H > prior_high(40)) & (lag(H) > lag(sma(a20, 20)) * 2.0), (L < prior_low(40)) & (lag(L) < lag(sma(a20, 20)) * 2.0)),
        "fibonacci": retraced,
        "four_day_breakout_le": signal(green4 & (C > s20) & (C > prior_high(4) + 0.5)),
        "ichimoku": signal((conv > base) & (C > lag(C, 26)), (conv < base) & (C < lag(C, 26))),
        "ichimoku_2": crossing(conv, base),
        "inside_day": signal(rng.eq(rmin(rng7, 7)), rng.eq(rmax(rng7, 7))),
        "key_rev_le": signal(true(lag((L < prior_low(5)) & (C > lag(C))))),
        "key_rev_lx": signal(C.ne(C), (H > prior_high(5)) & (C < lag(C))),
        "kiss_of_death": signal(C.ne(C), (lag(C) >= lag(top_c)) & (C < roll("min", L, 20, hi=-1))),
        "nr7": signal((rng < roll("min", rng, 6, hi=-1)) & (C > lag(C)), (rng < roll("min", rng, 6, hi=-1)) & (C < lag(C))),
        "on_balance_volume": signal(
            (C > prior_high(20)) & (lag(C) <= lag(prior_high(20))), (C < prior_low(20)) & (lag(C) >= lag(prior_low(20)))),
        "robotics_and_ai": signal((C > prior_high(20)) & (C > ema(C, 50)), (C < prior_low(20)) & (C < ema(C, 50))),
        "ironbot_trend_filter": signal((C >= fib_hi) & (z40 > 0.0), (C <= fib_lo) & (z40 < 0.0)),
        "trailing_stop_lx": signal(C.ne(C), L < trail),
        "detect_uptrend": signal(rmax(C, 20) - rmin(C, 20) > 5.0),
        "detect_pullback": signal(rmax(H, 10) - C > 1.0),
    })

    ts = col("ts")
    up_dn = run("sum", coalesce(signx(diff(C)), 0.0))
    lr = known(coalesce(logx(C / lag(C)), 0.0), 0)
    growth = run("sum", lr)
    t_bill = math.log(1.0033) / 21.0
    new_month = (SEQ.eq(0)) | month(ts).ne(month(lag(ts)))
    shares = run("sum", when(new_month, 1.0, otherwise=0.0) * 250.0 / C)
    first_c = run("first", C)
    # the running indices rise or fall exactly when their last step does
    vpt_step = known(coalesce(pct(C), 0.0), 0) * V
    draw = C * 0.96 / rmax(C, 252) - 1.0
    cum = {
        "advance_decline_indicator": signal((up_dn > lag(up_dn)) & (C > lag(C)), (up_dn < lag(up_dn)) & (C < lag(C))),
        "do_stocks_outperform_treasury_bills": signal(
            true(growth > SEQ * t_bill) & ~true(lag(growth) > lag(SEQ) * t_bill),
            true(growth < SEQ * t_bill) & ~true(lag(growth) < lag(SEQ) * t_bill)),
        "dollar_cost_averaging_vs_lump_sum_investing": state(shares * C, C * 3000.0 / first_c),
        "how_likely_are_you_to_go_broke_as_retired_or_fire": signal(C.ne(C), draw < -0.2),
        "negative_volume_index": signal((V > lag(V)) & (C > lag(C)), (V > lag(V)) & (C < lag(C))),
        "positive_volume_index": signal((V > lag(V)) & (C > lag(C)) & (V > 0.0)),
        "price_and_volume_trend": signal(
            (vpt_step > 0.0) & (lag(vpt_step) <= 0.0), (vpt_step < 0.0) & (lag(vpt_step) >= 0.0)),
        "stay_rich_portfolio": signal(
            (pct(C) > 0.04) & (C / top_c >= 0.7), (pct(C) < -0.04) & (C / top_c < 0.7)),
        "trailing_stop_sx": signal(H > lag(run("max", C)) * 1.01),
        "stop_running_low": signal(C <= run("min", C), C.ne(C)),
    }

    r1 = pct(C)
    vhf = (glob("max", C) - glob("min", C)) / rsum(absx(diff(C)), 14)
    z_all = (C - glob("avg", C)) / glob("stddev_pop", C)
    glb = {
        "big_moves": when(
            month(ts).isin([7, 12]), 0, true(r1 > glob("avg", r1)), 1, otherwise=-1),
        "turn_of_the_month_august_september": signal(
            r1 < glob("avg", r1) - glob("stddev_samp", r1) * 1.5, r1 > glob("avg", r1) + glob("stddev_samp", r1) * 1.5),
        "vhf": signal((vhf > 0.25) & (vhf < 0.75) & (C > s14), (vhf > 0.25) & (vhf < 0.75) & (C < s14)),
        "warren_buffett_etf_portfolio_90_10": state(glob("last_value", known(coalesce(r1, 0.0), 0)), 0.0),
        "calculate_z_score": signal(z_all < -1.0, z_all > 1.0),
        "simple_mean_reversion": signal((z_all < -1.0) & (sma(C, 30) > sma(C, 300)), (z_all > 1.0) & (sma(C, 30) < sma(C, 300))),
        "ehlers_universal_oscillator": state(
            I.universal_oscillator(C, 20), 0.0),
        "calculate_volatility": signal(rstd(r1, 20) > glob("stddev_samp", r1)),
    }

    pc, ph, pl = lag(C), lag(H), lag(L)
    r3, s3 = pc + (ph - pl) * 1.1 / 4.0, pc - (ph - pl) * 1.1 / 4.0
    r3s, s3s = C + (H - L) * 1.1 / 4.0, C - (H - L) * 1.1 / 4.0
    levels = {
        "camarilla_pivot": signal(C > r3, C < s3),
        "camarilla": signal((O < s3s) & (C > s3s), (O > r3s) & (C < r3s)),
    }
    return {
        "bands": bnd, "true_range": atr_rules, "breakouts": brk, "running_totals": cum, "whole_series": glb, "pivot_levels": levels,
    }
