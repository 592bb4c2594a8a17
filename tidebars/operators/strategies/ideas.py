"""Path rules that running values can express."""

from __future__ import annotations

from tidebars.functions.expr import C, H, L, O, absx, col, epoch_day, greatest, lag, lead, rmax, rmin, roll, run, signal, true, when
from tidebars.operators import indicators as I

TS = col("ts")


def families():
    low = run("min", when(true(C < lag(C)), C))
    high = run("max", when(true(C > lag(C)), C))
    o4, mid, mb = (O + H + L + C) / 4.0, (H + L) / 2.0, (O + C) / 2.0
    buy = ((lag(o4) < lag(mid)) & (lag(mid, 2) <= lag(o4)) & (lag(mid, 2) <= lag(o4, 3))) | (
        (lag(o4) < lag(mid, 3)) & (mb < lag(mid, 2)) & (lag(mb) < lag(mb, 2)))
    first_buy = run("min", when(true(buy), epoch_day(TS)))
    top_entry = run("max", when(true(buy), O))
    shape = ((lead(o4) < lead(mb)) & lead(mid, 2).eq(lead(mb, 3)) & (lead(mb) <= lead(mb, 4))) | (
        (lead(o4, 2) < mb) & (lead(mid, 4) < lead(o4, 3)) & (lead(mb) < lead(o4)))
    peak = lag(H, 5).eq(rmax(H, 11))
    p1 = run("last", when(true(peak), lag(H, 5)))
    p0 = run("last", when(true(peak), lag(p1)))
    engulf = (lag(C) < lag(O)) & (C > O) & (C >= lag(O)) & (O <= lag(C))
    ub, mb20, lb = I.bollinger(20)
    stop = C - I.atr0(20) * 3.0
    entry = engulf & (C > lb) & ((ub - H) / (H - stop) > 1.0)
    swing = (rmax(C, 20) - rmin(C, 20) > 5.0) & (rmax(H, 10) - C > 1.0) & (C - lag(C) > 0.5)
    strike = 1000.0
    path = {
        "hhll": signal((C >= low) & (lag(C) < low), (C <= high) & (lag(C) > high)),
        "gandalf": signal(buy),
        "gandalf_exit": signal(C.ne(C), (epoch_day(TS) - first_buy >= 10) | ((C < top_entry) & shape)),
        "double_top": signal(C.ne(C), (absx(p1 - p0) <= p0 * 0.01) & (C < rmin(lag(L), 11))),
        "covered_calls": signal(C < strike),
        "bollingerbandswithengulfing": signal(entry, true(lag(entry)) & ((H > ub) | (L < stop))),
        "mean_reversion_swing_le": signal(swing),
    }
    return {"paths": path}
