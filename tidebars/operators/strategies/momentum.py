"""Rules on returns, relative strength, oscillators and volume flow."""

from __future__ import annotations

from tidebars.functions.expr import (
    C, H, L, O, SEQ, V, absx, coalesce, cross_dn, cross_up, diff, ema, ema_alpha, expx, fill0, glob, greatest, known, lag, lead,
    least, logx, month, ncol, pct, rmax, rmin, roll, rstd, rsum, run, signal, signx, sma, sqrtx, tanhx, true, when,
)
from tidebars.operators import indicators as I
from tidebars.operators.strategies.means import crossing, state


def beyond(x, hi, lo=None):
    """Trend side: above ``hi`` long, below ``lo`` short."""
    return signal(x > hi, x < (-hi if lo is None else lo))


def reversal(x, low, high):
    """Oversold long, overbought short."""
    return signal(x < low, x > high)


# rule names by (bars, threshold): trend side of the n-bar return
RETURNS = {
    (21, 0.05): "3_day_low",
    (30, 0.03): "a_profitable_mean_reversion_strategy_using_week_days",
    (1, 0.001): "audchf",
    (1, 0.02): "buy_or_sell_stocks_in_volatile_markets geopolitical_risk monday_tuesday_in_nasdaq south_american",
    (5, 0.02): "can_you_use_the_same_strategy_on_all_indexes crude_oil_and_us_dollar",
    (1, 0.01): """clean_energy country_etfs_performance_per_quarter large_cap_effect
        rotating_monthly_between_stock_indexes_and_bonds_does_that_work""",
    (30, 0.0): "collapse_in_utilities_what_happens_next sp500_and_gold_rotate_in_and_out_of_the_assets",
    (1, 0.05): "hedge_fund",
    (1, 0.0): "meb_faber_ivy_portfolio the_shocking_impact_of_missing_a_few_days_in_the_stock_market",
    (14, 0.05): "oscillating_indicators",
    (30, 0.05): "timing_the_market_with_healthcare_stocks_rotation turn_of_the_month_for_september_dow_jones_dia",
    (21, 0.0): "turnaround_tuesday_in_a_bear_market",
    (14, 0.02): "turtle_trading_backtests",
}
# plain relative strength 14, 30 / 70, library form
RSI_PLAIN = """bitcoin e_mini_russell_2000 head_and_shoulders how_to_make_a_momentum_trading_strategy_in_python
    how_to_make_a_successful_trading_strategy_using_pine_script_on_tradingview new_5_day_low_in_spy_and_closes_in_the_low_of_the_range
    platinum_futures rsi_trading_strategy_cfd rsi2_on_spy rsi_signals_with_divergence usdcny"""


def families():
    r1 = pct(C)
    s20, s30 = sma(C, 20), sma(C, 30)
    ret = {name: beyond(pct(C, n), t) for (n, t), names in RETURNS.items() for name in names.split()}
    r30, sd30 = pct(C, 30), rstd(r1, 30)
    roc4 = sma(pct(C, 2), 4)
    ret.update({
        "asset_allocation": state(r1 * 0.6 + 0.2 * 0.02 / 252 + 0.2 * 0.01 / 252, 0.0),
        "audcad_forex": beyond(diff(C, 14), 0.001),
        "bogleheads_3_and_4_fund_portfolio": state(diff(C * V * (0.6 + 0.2 + 0.2)), 0.0),
        "cad_chf_forex": beyond(diff(C, 90), 0.0005),
        "derivatives": signal((pct(C, 10) > 0.0) & (C > s30), (pct(C, 10) < 0.0) & (C < s30)),
        "dow_jones_new_all_time_high": signal((r1 > 0.0) & (C > s20), (r1 < 0.0) & (C < s20)),
        "golden_cross_in_trading": state(sma(r1, 20), 0.0),
        "how_does_war_affect_the_stock_market": signal(
            (r30 < -0.05) & (sd30 > lag(sd30)), (r30 > 0.05) & (sd30 < lag(sd30))),
        "is_eur_jpy_a_leading_indicator_for_stocks": crossing(pct(C, 14), 0.0),
        "example_long_criteria": signal(sma(r1, 5) > 0.01),
        "example_short_criteria": signal(C.ne(C), sma(r1, 5) < -0.01),
        "momentumle": signal(cross_up(pct(C, 12), 0.0) | (lead(O) > H + 0.01)),
        "nasdaq_bond_ratio_rotation": crossing(r1, 0.0),
        "profit_target_sx": signal(diff(C) <= -0.75),
        "profit_target_lx": signal(C.ne(C), lead(C) >= C * 1.01),
        "rate_of_change": signal(cross_dn(I.roc(14), -20.0), cross_up(I.roc(14), 20.0)),
        "roc": crossing(roc4, 0.0),
        "roc_flags": signal(I.roc(12) >= 10.0, I.roc(12) <= -10.0),
        "rotation_strategy_in_gold_miners_and_sp_500": coalesce(
            run("last", when(true(r1 > 0.02), 1, true(r1 < -0.01), -1)), 0),
        "sector_etf_performance_per_quarter": signal((r1 > 0.01) & (rstd(r1, 14) < 0.02), (r1 < -0.01) & (rstd(r1, 14) < 0.02)),
        "sp_500_and_gold_miners_rotation_system": state(sma(pct(C, 20), 20), 0.0),
        "spectrum_bars_le": signal(C > lag(C, 10)),
        "stop_loss_lx": signal(C.ne(C), C < lag(C) * (1.0 - 0.75 / 100.0)),
        "stop_loss_sx": signal(r1 > 0.75 / 100.0),
        "what_are_the_worst_trading_days_for_stocks": signal((sma(r1, 10) > 0.0) & (C > s20), (sma(r1, 10) < 0.0) & (C < s20)),
        "what_happens_when_stock_markets_are_oversold": signal(pct(C, 10) <= -0.10),
        "detect_up_move": signal((diff(C) > 0.5) & (rmax(H, 10) - C > 1.0)),
    })

    r = I.rsi(14)
    simple = I.rsi(14, kind="simple")
    s14, s50, s10 = sma(C, 14), sma(C, 50), sma(C, 10)
    ub, mb, lb = I.bollinger(20)
    ru, _, rl = I.bollinger(20, 2.0, True, known(fill0(r), 0))
    rk = (r - rmin(r, 14)) / (rmax(r, 14) - rmin(r, 14))
    ibs14 = (C - rmin(L, 14)) / (rmax(H, 14) - rmin(L, 14))
    low3 = (r < 30.0) & (lag(r) < 30.0) & (lag(r, 2) < 30.0)
    z30 = I.zscore(30)
    r20 = I.rsi(20)
    sd14 = rstd(C, 14)
    trend20 = s20 > s50
    rsi = {n: reversal(r, 30.0, 70.0) for n in RSI_PLAIN.split()}
    rsi.update({
        "50_ema": signal((C > ema(C, 50)) & (r < 30.0), (C < ema(C, 50)) & (r > 70.0)),
        "cumulative_rsi_indicator": reversal(rsum(r, 2), 30.0, 70.0),
        "divergence": signal(
            C.eq(rmin(C, 5)) & (r > rmin(r, 5)), C.eq(rmax(C, 5)) & (r < rmax(r, 5))),
        "dynamic_zone_rsi": signal(r < rl, r > ru),
        "euraud_forex": signal((s14 > s50) & (simple < 70.0), (s14 < s50) & (simple > 30.0)),
        "eurusd": signal((r < 30.0) & (z30 < -1.0), (r > 70.0) & (z30 > 1.0)),
        "free_swing": signal(trend20 & (r < 30.0), (s20 < s50) & (r > 70.0)),
        "gbp_aud": signal(trend20 & (r > 30.0), (s20 < s50) & (r < 70.0)),
        "gbpchf_forex": reversal(simple, 30.0, 70.0),
        "gold_envelope": signal(cross_up(r, 70.0), cross_dn(r, 30.0)),
        "larry_connors_r3": signal(I.rsi(2) < 30.0, I.rsi(2) > 70.0),
        "nzd_chf_forex": reversal(simple, 30.0, 70.0),
        "post_opex_week_august": signal((C > s14) & (r < 70.0), (C < s14) & (r > 30.0)),
        "price_swing": reversal(r20, 30.0, 70.0),
        "relative_strength_index_and_moving_average": signal((simple < 30.0) & (C > s20), (simple > 70.0) & (C < s20)),
        "rsi": signal(cross_dn(r, 30.0), cross_up(r, 70.0)),
        "rsi_2": signal(cross_up(r, 30.0), cross_dn(r, 70.0)),
        "rsi_flags": signal(r <= 30.0, r >= 70.0),
        "sell_the_rip": signal(C.ne(C), (r > 70.0) & (C >= ub)),
        "sp_500_mean_reversion_using_ibs_and_rsi": signal((r < 30.0) & (ibs14 < 0.2), (r > 70.0) & (ibs14 > 0.8)),
        "stochrsi": signal(rk <= 0.2, rk >= 0.8),
        "supertrend_indicator": signal(cross_up(r, 30.0), cross_dn(r, 70.0)),
        "the_stochastic_indicator_does_it_work": reversal(lag(r), 30.0, 70.0),
        "triple_rsi": signal(low3 & (C < sma(C, 200)), (r > 70.0) & (C > sma(C, 200))),
        "vix_futures": signal((r < 30.0) & (s10 > s30), (r > 70.0) & (s10 < s30)),
        "vols_switch": signal((sd14 < lag(sd14)) & (C > s50) & (r > 30.0), (sd14 < lag(sd14)) & (C < s50) & (r < 70.0)),
        "what_happens_when_stock_markets_are_overbought": signal(C.ne(C), r > 70.0),
    })

    k14, d14 = I.stochastic(14, 3)
    ao = I.awesome()
    up25, dn25 = I.aroon(25)
    line, sig, hist = I.macd()
    cci = I.cci(20)
    cm = (sma(I._updown(C, True)[0], 14) - sma(I._updown(C, True)[1], 14)) * 100.0 / (sma(I._updown(C, True)[0], 14) + sma(I._updown(C, True)[1], 14))
    cms = I.cmo_sum(14)
    chop = I.log10x((rmax(C, 14) - rmin(C, 14)) / (rmax(H, 14) - sma(C, 14))) * 100.0
    copp = sma(pct(C, 11) + pct(C, 14), 10)
    tsi = I.tsi()
    med14 = C / roll("percentile", C, 14, p=0.5)
    dvo = med14 * 100.0 / rmax(C, 14) - sma(med14 * 100.0 / rmax(C, 14), 14)
    disp = (C - s20) * 100.0 / s20
    dp = C - lag(s20, 11)
    er = diff(C, 10) / rsum(absx(diff(C)), 10)
    change25 = ema(diff(C), 25)
    ergo = change25 * 100.0 / ema(change25, 13)
    ergo0 = known(fill0(ergo), 0)
    pos10 = (C - rmin(C, 10)) / (rmax(C, 10) - rmin(C, 10))
    posc = least(pos10, 0.999999)
    fisher = logx((posc + 1.0) / (1.0 - posc)) * 0.5
    lr = logx(C / lag(C))
    fdi = sma(rstd(lr, 14) / sma(absx(lr), 14), 14) + 1.0
    wr = I.williams_r(14)
    ift = (k14 / 100.0) * (k14 / 100.0) * 100.0
    ifts = sma(ift, 3)
    k3, k3s = I.kst()
    roc_sum = rsum(pct(C, 10) + pct(C, 20) * 2.0 + pct(C, 30) * 3.0 + pct(C, 40) * 4.0, 10)
    kst_sig = sma(roc_sum, 9)
    mi = I.mass_index()
    pos14 = (C - rmin(L, 14)) * 100.0 / (rmax(H, 14) - rmin(L, 14))
    means = [sma(C, n) for n in (5, 10, 20, 30, 40, 50, 60)]
    rainbow = (greatest(*means) - least(*means)) / (greatest(*means) + least(*means))
    rei = (pos14 - 50.0) * 2.0
    d14c = diff(C, 14)
    rmi_u, rmi_d = sma(greatest(d14c, 0.0), 14), sma(greatest(-d14c, 0.0), 14)
    rmi = rmi_u * 100.0 / (rmi_u + rmi_d)
    rvi = sma(C - O, 14) / sma(H - L, 14)
    rvol = (rstd(H, 14) - rstd(L, 14)) / (rstd(H, 14) + rstd(L, 14))
    stc = I.stc()
    half = (rmax(H, 14) + rmin(L, 14)) / 2.0
    smi = sma((C - half) * 100.0 / ((rmax(H, 14) - rmin(L, 14)) / 2.0), 3)
    swing = logx(C / lag(C)) / logx(lag(H) / lag(L))
    uo = I.ultimate()
    vip, vim = I.vortex(14)
    wk = (C - lag(sma(C, 5))) / lag(sma(C, 5))
    wr5 = (rmax(C, 5) - C) * -100.0 / (rmax(C, 5) - rmin(C, 5))
    lagrange = lag(H) - lag(L)
    asi = rsum(fill0(when(true(C > lag(C)), (H - lag(H)) * 100.0 / lagrange, otherwise=(L - lag(L)) * 100.0 / lagrange)), 14)
    er_avg = I.efficiency(C, 14)
    rms = sqrtx(sma(r1 * r1, 10))
    eleg = I.supersmoother(known(sqrtx(sma(C * C, 10)), 9), 10)
    scaled = (eleg - glob("min", eleg)) / (glob("max", eleg) - glob("min", eleg)) * 2.0 - 1.0
    osc = {
        "awesome_oscillator": crossing(ao, 0.0),
        "bb_divergence_strat": signal(
            (rmax(r1 * 100.0, 3) > 20.0) & (line > sig) & (I.roc(3) > 0.0) & (k14 < 85.0),
            (rmin(r1 * 100.0, 3) < -20.0) & (line < sig) & (I.roc(3) < 0.0) & (k14 > 85.0)),
        "accumulative_swing_index": crossing(asi, 0.0),
        "all_time_high_trading_strategy_for_international_stocks": reversal(k14, 20.0, 80.0),
        "aroon": signal(
            (up25 >= 70.0) & (up25 > dn25) & ~true(lag(up25) > lag(dn25)), (dn25 >= 70.0) & (dn25 > up25) & ~true(lag(dn25) > lag(up25))),
        "cci": signal(cross_up(cci, -100.0), cross_dn(cci, 100.0)),
        "chande_momentum_oscillator": reversal(cm, -50.0, 50.0),
        "choppiness_index": signal(chop < 38.2, chop > 61.8),
        "cmo_absolute_indicator": reversal(absx(cms), 20.0, 70.0),
        "coppock_curve": crossing(copp, 0.0),
        "crude_oil": crossing(tsi, 0.0),
        "david_varadi_oscillator": crossing(dvo, 0.0),
        "disparity_index": beyond(disp, 5.0),
        "dpo": crossing(dp, 0.0),
        "efficiency_ratio": signal(cross_up(er, 0.5), cross_dn(er, 0.2)),
        "ergodic_oscillator": crossing(ergo0 - ema(ergo0, 9), 0.0),
        "fisher_transform": signal(cross_up(fisher, 1.0), cross_dn(fisher, -1.0)),
        "fractal_dimension_index": signal(fdi < 1.3, fdi > 1.5),
        "how_does_pairs_trading_work_is_it_profitable": crossing(tsi, 0.0),
        "how_i_created_a_trend_following_trading_strategy_using_python": signal(cross_dn(wr, -20.0), cross_up(wr, -80.0)),
        "ift_stoch": signal(cross_up(ifts, 30.0), cross_dn(ifts, 60.0) & (C < sma(C, 165))),
        "kairi_relative_index": signal(cross_dn(disp, -10.0), cross_up(disp, 10.0)),
        "kst_oscillator": crossing(roc_sum, kst_sig),
        "kst": crossing(k3, k3s),
        "mass_index": signal(
            (mi > 27.0) & (lag(mi) <= 26.5) & (ema(C, 9) > ema(C, 25)), (mi > 27.0) & (lag(mi) <= 26.5) & (ema(C, 9) < ema(C, 25))),
        "polarized_fractal_efficiency": crossing(pos14 - 50.0, 0.0),
        "rainbow_oscillator": signal(rainbow > 0.1),
        "range_expansion_index": signal(cross_up(rei, -60.0), cross_dn(rei, 60.0)),
        "relative_momentum_index": reversal(rmi, 30.0, 70.0),
        "relative_vigor_index": crossing(rvi, 0.0),
        "relative_volatility_index": crossing(rvol, 0.0),
        "schaff_trend_cycle_indicator": signal(cross_up(stc, 25.0), cross_dn(stc, 75.0)),
        "stc": signal(stc > 75.0, stc < 25.0),
        "stoch": crossing(k14, d14),
        "stochastic_momentum_index": signal(cross_up(smi, 40.0), cross_dn(smi, -40.0)),
        "stochastic": signal((k14 > d14) & (k14 < 20.0), (k14 < d14) & (k14 > 80.0)),
        "swing_index": crossing(swing, 0.0),
        "tsi": crossing(tsi, 0.0),
        "ultimate_oscillator": signal(cross_up(uo, 30.0), cross_dn(uo, 70.0)),
        "vortex": crossing(vip, vim),
        "weekly_mean_reversion_system_for_sp_500_stocks": reversal(wk, -0.05, 0.05),
        "which_is_the_best_indicator_for_swing": reversal(wr, -80.0, -20.0),
        "williams_r": signal(wr5 > -80.0, wr5 < -20.0),
        "williams": signal(wr <= -80.0, wr >= -20.0),
        "rms": signal(rms > sma(rms, 10)),
        "compute_er": signal(er_avg > 0.5, er_avg < 0.2),
        "ertrend": signal(
            (er_avg > rmin(er_avg, 7, 1) * 1.5) & (er_avg > 0.5) & (er_avg < 1.0) & (C > s14), (lead(C) < s14) & (lead(C, 2) > s14)),
        "elegant_oscillator": signal(cross_up(tanhx(scaled), 0.5), cross_dn(tanhx(scaled), -0.5)),
    }

    cmf = I.cmf(20)
    mf = I.mfi(14)
    v20 = sma(V, 20)
    emv = (H - L) * 0.5 / V * 1e6
    emv14 = sma(emv - sma(emv, 14), 14)
    _, eom = I.ease_of_movement(14)
    fi = rsum(diff(C, 13) * V, 13)
    up3 = (C > lag(C)) & (lag(C) > lag(C, 2)) & (lag(C, 2) > lag(C, 3))
    mfac = (H - L) / V
    sv = when(C > lag(C), V, C < lag(C), -V, otherwise=0.0)
    sv = known(coalesce(sv, 0.0), 0)
    flow = rsum(when(true(I.TYP > lag(I.TYP)), V, otherwise=-V), 14)
    vap = rsum(sv, 14) * 100.0 / rsum(V, 14)
    vo = (sma(V, 5) - v20) * 100.0 / v20
    vzo = rsum(sv, 14) / sma(V, 14)
    tmf = ema(I.close_location() * V, 21)
    vw50 = I.vwap_rolling(50)
    vpn = ema(sv, 14, "adjusted") * 100.0 / ema(V, 14, "adjusted")
    volume = {
        "acc_dist_strat": signal(
            ((H - L) / lag(H - L, 4) < 0.75) & (L > roll("min", L, 12, hi=-1)) & (C > roll("max", H, 12, hi=-1))
            & (sma(V, 4) / lag(sma(V, 4), 4) > 1.0), C < roll("min", L, 12, hi=-1)),
        "cmf": beyond(cmf, 0.1),
        "ease_of_movement_indicator": crossing(emv14, 0.0),
        "elder_force_index": crossing(fi, 0.0),
        "eom": state(eom, 0.0),
        "follow_through_day": signal(true(lag(up3, 3)) & (C > lag(C)) & (V - lag(V) > lag(V) * 1.5)),
        "market_facilitation_index": signal(cross_up(mfac, 0.5), cross_dn(mfac, 0.2)),
        "mfi": signal(mf > 80.0, mf < 20.0),
        "money_flow_index": reversal(mf, 20.0, 80.0),
        "spy_strategies_using_vix_indicator": signal((C > sma(C, 5)) & (V > sma(V, 5)), (C < sma(C, 5)) & (V < sma(V, 5))),
        "time_segmented_volume": crossing(rsum(sv, 20), 0.0),
        "twiggs_money_flow": crossing(tmf, 0.0),
        "volume_accumulation_percentage": state(vap, 0.0),
        "volume_flow_indicator": beyond(flow, glob("stddev_pop", flow) * 1.5),
        "volume_oscillator": crossing(vo, 0.0),
        "volume": signal(V > v20 * 1.5, V < v20 / 1.5),
        "volume_zone_oscillator": crossing(vzo, 0.0),
        "vpn": signal(
            (vpn > 10.0) & (C > I.vwap_rolling(10)) & (diff(sma(V, 50)) > 0.0) & (r < 90.0),
            (vpn < sma(vpn, 10)) & (C < rmax(C, 14) - I.atr0(14))),
        "vwma_breakouts": state(vw50, sma(vw50, 70)),
    }
    return {"returns": ret, "relative_strength": rsi, "oscillators": osc, "volume_flow": volume}
