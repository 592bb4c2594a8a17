"""Rules on the shape of single bars, short runs and opening gaps."""

from __future__ import annotations

from tidebars.functions.expr import (
    C, H, L, O, V, absx, col, diff, greatest, lag, lead, least, month, pct, rmax, rmin, roll, rsum, run, signal, sma, true, when,
)
from tidebars.operators import indicators as I
from tidebars.operators.strategies.means import state


def rising(n):
    out = C > lag(C)
    for k in range(1, n):
        out = out & (lag(C, k) > lag(C, k + 1))
    return out


def falling(n):
    out = C < lag(C)
    for k in range(1, n):
        out = out & (lag(C, k) < lag(C, k + 1))
    return out


def families():
    body = C - O
    po, pc, ph, pl = lag(O), lag(C), lag(H), lag(L)
    bull_engulf = (pc < po) & (C > O) & (C >= po) & (O <= pc)
    bear_engulf = (pc > po) & (C < O) & (C <= po) & (O >= pc)
    pierce = (pc < po) & (C > O) & (O < pl) & (C > (po + pc) / 2.0)
    harami = (pc < po) & (C > O) & (O > pc) & (C < po)
    inside = (H < ph) & (L > pl)
    up_close = C > pc
    wick_lo, wick_hi = least(O, C) - L, H - greatest(O, C)
    ibs = (C - L) / (H - L)
    down = when(C < pc, 1.0, otherwise=0.0)
    ts = col("ts")
    quiet = month(ts).isin([7, 12])
    c4, c3, c2, c1 = (lag(C, k) for k in (4, 3, 2, 1))
    ha = (po + pc) / 2.0
    bar = {
        "200_day_moving_average": signal(body > O * 0.01, body < O * -0.01),
        "3_bullish_candlestick_patterns_that_work": signal(bull_engulf | pierce | harami),
        "3_days_down_overnight": signal(falling(3)),
        "consbarsdownse": signal(C.ne(C), falling(4)),
        "cons_bars_up_le": signal(rising(4) & ~true(lag(rising(4)))),
        "decoding_the_post_holiday_effect_in_stocks": when(quiet, 0, true(up_close), 1, true(C < pc), -1, otherwise=0),
        "different_trade_entries_comparisons": state(C, O),
        "dow_theory": signal((H > ph) & (L > pl), (H < ph) & (L < pl)),
        "elliott_wave": signal(
            (c3 > c4) & (c2 > c3) & (c1 < c2) & (C > c2), (c3 < c4) & (c2 > c3) & (c1 > c2) & (C < c1)),
        "inside_bar_le": signal(inside & (C > O)),
        "inside_bar_se": signal(C.ne(C), true(lag(inside)) & (C < O)),
        "internal_bar_strength_ibs_indicator": signal(ibs < 0.2, ibs > 0.8),
        "jp_morgan_vix_buy_signal": state(C, pc),
        "larry_connors_multiple_days_up_and_multiple_days_down": signal(rsum(down, 5) >= 4.0),
        "lower_highs_and_lower_lows_pattern": signal(C.ne(C), (H < ph) & (L < pl)),
        "monthly_momentum_in_spy_and_eem": state(C, pc),
        "nasdaq_qqq_mean_reversion": signal((C < ph) & (C < pc), (C > ph) | (C > pc)),
        "ohl": signal(O.eq(L), O.eq(H)),
        "performance_of_the_opex_week_of_september": state(C, O),
        "price_action": signal(
            (absx(body) <= (H - L) * 0.3) & (wick_lo >= absx(body) * 2.0) & (wick_hi < wick_lo),
            (absx(body) <= (H - L) * 0.3) & (wick_hi >= absx(body) * 2.0) & (wick_lo < wick_hi)),
        "reversal_day": signal((L < pl) & (C > ph) & (C > O)),
        "spy_day_trading_strategy_2": signal(bull_engulf, bear_engulf),
        "teslas_stock_price_booms_every_time_this_happens": signal(rising(3), true(lead(rising(3), 6))),
        "three_bar_inside_bar_le": signal(true(lag(inside)) & (lag(C, 2) > lag(C, 3)) & (C > pc)),
        "three_bar_inside_bar_se": signal(C.ne(C), true(lag(inside)) & (lag(C, 2) < lag(C, 3)) & (C < pc)),
        "typical_price": state(C, I.TYP),
        "ha": state((O + H + L + C) / 4.0, ha),
        "weighted_close": signal((H + L + C * 2.0) / 4.0 > C, (H + L + C * 2.0) / 4.0 < C),
        "what_happens_the_day_after_sp_500_is_down": signal(C < pc, C > pc),
        "when_to_sell_a_stock_or_position": signal(C.ne(C), C > ph),
        "williamsvixfix_explained_does_it_work": when(true(bull_engulf), 1, otherwise=-1),
        "calculate_mid_range": state(C, (H + L) / 2.0),
    }
    v20 = sma(V, 20)
    exhausted = ((po - pc) / po > 0.02) & (lag(V) > lag(v20) * 1.5)
    away = (C > pc * 1.02) & (V > v20 * 1.5)
    gap_mean = sma(O - pc, 14)
    gap = {
        "exhaustion_gap": signal(true(lag(exhausted)), true(exhausted)),
        "gap": signal((O < pl) & (C > O), (O > ph) & (C < O)),
        "gap_down_se": signal(C.ne(C), H < pl),
        "gap_momentum": state(gap_mean, lag(gap_mean)),
        "gap_reversal": signal(((O - pl) / pl > 0.10) & (H - O > 0.5)),
        "gap_up_le": signal(lead(L) > H),
        "runaway_gaps": signal(away, true(lag(away))),
        "weekend_gold": state(O, pc),
    }
    return {"bar_shapes": bar, "gaps": gap}
