"""Calendar rules: predicates on the bar's own date and short carried states."""

from __future__ import annotations

from tidebars.functions.expr import (
    C, H, L, SEQ, coalesce, col, dayom, days_in_month, epoch_day, floorx, glob, isodow, lag, lead, minute_of_day, month, pct, run,
    signal, sma, true, when, year_,
)
from tidebars.operators.strategies.means import state

TS = col("ts")
M, D, DOW = month(TS), dayom(TS), isodow(TS)
NEW_MONTH = SEQ.eq(0) | M.ne(month(lag(TS)))
THIRD_FRIDAY = DOW.eq(5) & (D >= 15) & (D <= 21)

# fixed values: days since 1970-01-01
ROSH_HASHANAH = [19615, 19616, 19617]          # 2023-09-15 .. 2023-09-17
SELL_DAY, BUY_DAY = 19615, 19624               # 2023-09-15, 2023-09-24
NEW_MOON_2000 = 10962.76                       # 2000-01-06 18:14 UTC
SYNODIC_MONTH = 29.530588853


def moon_age():
    """Share of the synodic month passed since new moon, 0..1."""
    turns = (epoch_day(TS) + 0.5 - NEW_MOON_2000) / SYNODIC_MONTH
    return turns - floorx(turns)


def carried(first, second):
    """+1 from ``first`` on, -1 from ``second`` on, 0 before either."""
    return coalesce(run("last", when(true(first), 1, true(second), -1)), 0)


def in_session(lo, hi):
    """Minutes of the day, both ends included."""
    m = minute_of_day(TS)
    return (m >= lo) & (m <= hi)


def families():
    month_end, month_start = D.eq(days_in_month(TS)), D.eq(1)
    last_bar = lead(M).ne(M)
    age = moon_age()
    width = 0.5 / SYNODIC_MONTH
    rank = run("sum", when(M.eq(12), 1, otherwise=0)) - coalesce(
        run("last", when(NEW_MONTH & M.eq(12), run("sum", when(M.eq(12), 1, otherwise=0)) - 1)), 0)
    even = (D - floorx(D / 2.0) * 2.0).eq(0.0)
    seen_even = run("max", when(even, 1, otherwise=0)).eq(1)
    near_end = D > days_in_month(TS) - 10
    quarter = M.isin([3, 6, 9, 12])
    cal = {
        "calendar_effects_long_term_treasuries": when(D <= 7, -1, otherwise=1),
        "cci_2": when((M >= 1) & (M <= 3), 1, otherwise=-1),
        "dax40_seasonal": when(M >= 10, 1, otherwise=-1),
        "day_of_the_week": DOW,
        "do_stocks_drop_or_rise_before_a_3_day_weekend": when(DOW.eq(5), when(true(lead(C) > C), 1, otherwise=-1), otherwise=0),
        "end_of_month_effect_in_bitcoin": carried(D.eq(days_in_month(TS) - 9), D.eq(10)),
        "end_of_month_effect_in_nifty_50_does_it_exist_turn_of_the_month": coalesce(lag(when(near_end, 1, otherwise=0)), 0),
        "end_of_year_stock_market_rally": signal(M.eq(12) & (rank >= 6) & (rank <= 10)),
        "full_moon_moon_phases_lunar_cycles": signal((age < width) | (age > 1.0 - width), (age > 0.5 - width) & (age < 0.5 + width)),
        "halloween": signal(M.eq(10) & D.eq(1) & (C > sma(C, 30)), M.eq(5) & D.eq(1)),
        "italian_stock_market": signal(DOW.isin([2, 3])),
        "litecoin": when(M.eq(5), 1, otherwise=-1),
        "retail_stocks": signal(month_end, month_start),
        "rosh_hashanah": signal(C.ne(C), epoch_day(TS).isin(ROSH_HASHANAH)),
        "russell_2000_rebalancing": carried(M.eq(6) & (D > 23) & ~true(lag(M.eq(6) & (D > 23))), M.eq(7) & NEW_MONTH),
        "seasonal_trading_strategy_silver": when(M.isin([1, 7]), 1, M.isin([6, 9]), -1, otherwise=0),
        "sell_rosh_hashanah_buy_yom_kippur": carried(epoch_day(TS).eq(BUY_DAY), epoch_day(TS).eq(SELL_DAY)),
        "the_santa_claus_rally_in_dax_and_euro_stoxx_50": signal((M.eq(12) & (D >= 26)) | (M.eq(1) & (D <= 2))),
        "the_santa_claus_rally_in_nifty": signal(
            carried(M.eq(12) & DOW.eq(5) & (D >= 8) & (D <= 14), M.eq(1) & (D <= 7) & (DOW <= 5)).eq(1)),
        "the_worst_week_of_the_year_for_stocks": signal(
            C.ne(C), M.eq(9) & (D - DOW + 5 >= 22) & (D - DOW + 5 <= 28) & (DOW <= 5)),
        "trading_the_futures_expiration_week_in_dax_40": signal(quarter & THIRD_FRIDAY, quarter & DOW.eq(1) & (D <= 7)),
        "turn_of_the_month": carried(true(last_bar), NEW_MONTH.eq(False) & (D >= 7) & (lag(D) < 7)),
        "turnaround_tuesday": signal(DOW.eq(1) & (lag(C) < lag(C, 3) * 0.99)),
        "yale_hirsch_best_6_months_timing_model": when((M >= 5) & (M <= 10), 1, otherwise=-1),
        "even_vs_odd_days_trading_strategy_backtest_sp_500": when(even, 1, seen_even, -1, otherwise=0),
    }

    asian_hi = glob("max", when(in_session(0, 360), H))
    asian_lo = glob("min", when(in_session(0, 360), L))
    month_close = run("last", when(NEW_MONTH, lag(C)))
    shares = run("sum", when(NEW_MONTH, C * 0.0 + 100.0, otherwise=0.0) / C)
    res = {
        "london_breakout": signal(in_session(480, 660) & (H > asian_hi), in_session(480, 660) & (L < asian_lo)),
        "investment": when(NEW_MONTH, 1, otherwise=0),
        "unlocking_the_power_of_trading_days_analyzing_sp_500_gold_and_treasuries": when(
            M.isin([7, 12]), 0, otherwise=carried(NEW_MONTH, true(last_bar))),
        "month_close_state": state(C, month_close),
        "investment_shares_worth": signal(shares * C > 0.0),
    }
    return {"calendar": cal, "periods": res}
