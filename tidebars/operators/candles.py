"""Candlestick patterns as feature expressions: -100 / 0 / +100 per bar.

Bar ``k`` is ``k`` bars back.  Candle sizes are compared with averages of the
bars before: long / short body (10 bars), doji and very short shadow (a tenth
of the 10-bar range), near / far / equal distances (5-bar range).
"""

from __future__ import annotations

from tidebars.functions.expr import C, H, L, O, absx, greatest, lag, least, sma, true, when

BODY, RANGE = absx(C - O), H - L
SHADOWS = RANGE - BODY


def o(k): return lag(O, k)
def h(k): return lag(H, k)
def l(k): return lag(L, k)
def c(k): return lag(C, k)
def body(k): return absx(c(k) - o(k))
def top(k): return greatest(o(k), c(k))
def bot(k): return least(o(k), c(k))
def upper(k): return h(k) - top(k)
def lower(k): return bot(k) - l(k)
def white(k): return c(k) >= o(k)
def black(k): return c(k) < o(k)
def same(i, j): return (white(i) & white(j)) | (black(i) & black(j))
def opposite(i, j): return (white(i) & black(j)) | (black(i) & white(j))


def _avg(x, n, k, factor): return lag(sma(x, n), k + 1) * factor
def body_avg(k): return _avg(BODY, 10, k, 1.0)
def doji_size(k): return _avg(RANGE, 10, k, 0.1)
def tiny(k): return _avg(RANGE, 10, k, 0.1)
def short_shadow(k): return _avg(SHADOWS, 10, k, 0.5)
def near(k): return _avg(RANGE, 5, k, 0.2)
def far(k): return _avg(RANGE, 5, k, 0.6)
def equal(k): return _avg(RANGE, 5, k, 0.05)


def is_long(k): return body(k) > body_avg(k)
def is_short(k): return body(k) < body_avg(k)
def is_small(k): return body(k) <= body_avg(k)
def is_doji(k): return body(k) <= doji_size(k)
def no_upper(k): return upper(k) < tiny(k)
def no_lower(k): return lower(k) < tiny(k)
def gap_up(i, j): return bot(i) > top(j)
def gap_down(i, j): return top(i) < bot(j)
def full_gap_up(i, j): return l(i) > h(j)
def full_gap_down(i, j): return h(i) < l(j)
def within(x, mid, tol): return (x <= mid + tol) & (x >= mid - tol)
def inside_body(i, j): return (top(i) < top(j)) & (bot(i) > bot(j))


def bull(cond): return when(true(cond), 100, otherwise=0)
def bear(cond): return when(true(cond), -100, otherwise=0)
def either(up, down): return when(true(up), 100, true(down), -100, otherwise=0)
def by_color(cond, k=0): return either(cond & white(k), cond & black(k))
def against(cond, k): return either(cond & black(k), cond & white(k))


def _opens_in_body(i, j, black_bars=True):
    return (o(i) < o(j)) & (o(i) > c(j)) if black_bars else (o(i) > o(j)) & (o(i) <= c(j) + near(j))


def _marubozu(k):
    return is_long(k) & no_upper(k) & no_lower(k)


def _confirmed(base):
    """A failed inside-bar break counts again (doubled) when one of the next three
    bars closes beyond the bar before the break."""
    up, down = base.eq(100), base.eq(-100)
    def later(side, hit):
        out = None
        for k in (1, 2, 3):
            first = lag(side, k) & hit(k)
            for j in range(1, k):
                first = first & ~true(lag(side, j) & hit(j)) & lag(base, j).eq(0)
            out = first if out is None else out | first
        return out
    broke_up = later(up, lambda k: C > h(k + 1))
    broke_down = later(down, lambda k: C < l(k + 1))
    return when(base.ne(0), base, true(broke_up), 200, true(broke_down), -200, otherwise=0)


def patterns() -> dict:
    p = {}
    three_white = white(2) & white(1) & white(0) & (c(0) > c(1)) & (c(1) > c(2))
    three_black = black(2) & black(1) & black(0)
    star2 = is_long(2)
    p["CDL2CROWS"] = bear(white(2) & star2 & black(1) & gap_up(1, 2) & black(0) & _opens_in_body(0, 1) & (c(0) > o(2)) & (c(0) < c(2)))
    p["CDL3BLACKCROWS"] = bear(
        white(3) & three_black & no_lower(2) & no_lower(1) & no_lower(0) & _opens_in_body(1, 2) & _opens_in_body(0, 1)
        & (h(3) > c(2)) & (c(2) > c(1)) & (c(1) > c(0)))
    harami2 = star2 & is_small(1) & inside_body(1, 2)
    p["CDL3INSIDE"] = either(harami2 & black(2) & white(0) & (c(0) > o(2)), harami2 & white(2) & black(0) & (c(0) < o(2)))
    strike = same(3, 2) & same(2, 1) & opposite(1, 0)
    for i, j in ((2, 3), (1, 2)):
        strike = strike & (o(i) >= bot(j) - near(j)) & (o(i) <= top(j) + near(j))
    p["CDL3LINESTRIKE"] = either(
        strike & white(1) & (c(1) > c(2)) & (c(2) > c(3)) & (o(0) > c(1)) & (c(0) < o(3)),
        strike & black(1) & (c(1) < c(2)) & (c(2) < c(3)) & (o(0) < c(1)) & (c(0) > o(3)))
    p["CDL3STARSINSOUTH"] = bull(
        three_black & star2 & (lower(2) > body(2)) & (body(1) < body(2)) & (o(1) > c(2)) & (o(1) <= h(2)) & (l(1) < c(2)) & (l(1) >= l(2))
        & (lower(1) > tiny(1)) & is_short(0) & no_lower(0) & no_upper(0) & (l(0) > l(1)) & (h(0) < h(1)))
    steps = _opens_in_body(1, 2, False) & _opens_in_body(0, 1, False)
    p["CDL3WHITESOLDIERS"] = bull(
        three_white & no_upper(2) & no_upper(1) & no_upper(0) & steps
        & (body(1) > body(2) - far(2)) & (body(0) > body(1) - far(1)) & (body(0) > body_avg(0)))
    baby = star2 & is_doji(1) & is_long(0)
    p["CDLABANDONEDBABY"] = either(
        baby & black(2) & white(0) & (c(0) > c(2) + body(2) * 0.3) & full_gap_down(1, 2) & full_gap_up(0, 1),
        baby & white(2) & black(0) & (c(0) < c(2) - body(2) * 0.3) & full_gap_up(1, 2) & full_gap_down(0, 1))
    weak = (
        ((body(1) < body(2) - far(2)) & (body(0) < body(1) + near(1))) | (body(0) < body(1) - far(1))
        | ((body(0) < body(1)) & (body(1) < body(2)) & ((upper(0) > short_shadow(0)) | (upper(1) > short_shadow(1))))
        | ((body(0) < body(1)) & (upper(0) > body(0))))
    p["CDLADVANCEBLOCK"] = bear(three_white & steps & star2 & (upper(2) < short_shadow(2)) & weak)
    p["CDLBELTHOLD"] = either(is_long(0) & white(0) & no_lower(0), is_long(0) & black(0) & no_upper(0))
    away = is_long(4) & same(4, 3) & same(3, 1) & opposite(1, 0)
    p["CDLBREAKAWAY"] = either(
        away & black(4) & gap_down(3, 4) & (h(2) < h(3)) & (l(2) < l(3)) & (h(1) < h(2)) & (l(1) < l(2)) & (c(0) > o(3)) & (c(0) < c(4)),
        away & white(4) & gap_up(3, 4) & (h(2) > h(3)) & (l(2) > l(3)) & (h(1) > h(2)) & (l(1) > l(2)) & (c(0) < o(3)) & (c(0) > c(4)))
    p["CDLCLOSINGMARUBOZU"] = either(is_long(0) & white(0) & no_upper(0), is_long(0) & black(0) & no_lower(0))
    p["CDLCONCEALBABYSWALL"] = bull(
        black(3) & three_black & no_lower(3) & no_upper(3) & no_lower(2) & no_upper(2) & gap_down(1, 2) & (upper(1) > tiny(1))
        & (h(1) > c(2)) & (h(0) > h(1)) & (l(0) < l(1)))
    p["CDLCOUNTERATTACK"] = by_color(opposite(1, 0) & is_long(1) & is_long(0) & within(c(0), c(1), equal(1)))
    p["CDLDARKCLOUDCOVER"] = bear(white(1) & is_long(1) & black(0) & (o(0) > h(1)) & (c(0) > o(1)) & (c(0) < c(1) - body(1) * 0.5))
    p["CDLDOJI"] = bull(is_doji(0))
    p["CDLDOJISTAR"] = either(is_long(1) & is_doji(0) & black(1) & gap_down(0, 1), is_long(1) & is_doji(0) & white(1) & gap_up(0, 1))
    p["CDLDRAGONFLYDOJI"] = bull(is_doji(0) & no_upper(0) & (lower(0) > tiny(0)))
    p["CDLENGULFING"] = either(
        white(0) & black(1) & (((c(0) >= o(1)) & (o(0) < c(1))) | ((c(0) > o(1)) & (o(0) <= c(1)))),
        black(0) & white(1) & (((o(0) >= c(1)) & (c(0) < o(1))) | ((o(0) > c(1)) & (c(0) <= o(1)))))
    evening = star2 & white(2) & gap_up(1, 2) & is_long(0) & black(0) & (c(0) < c(2) - body(2) * 0.3)
    morning = star2 & black(2) & gap_down(1, 2) & is_long(0) & white(0) & (c(0) > c(2) + body(2) * 0.3)
    p["CDLEVENINGDOJISTAR"] = bear(evening & is_doji(1))
    p["CDLEVENINGSTAR"] = bear(evening & is_small(1))
    side = white(1) & white(0) & within(body(0), body(1), near(1)) & within(o(0), o(1), equal(1))
    p["CDLGAPSIDESIDEWHITE"] = either(side & gap_up(1, 2) & gap_up(0, 2), side & gap_down(1, 2) & gap_down(0, 2))
    p["CDLGRAVESTONEDOJI"] = bull(is_doji(0) & no_lower(0) & (upper(0) > tiny(0)))
    hammer = is_short(0) & (lower(0) > body(0)) & no_upper(0)
    p["CDLHAMMER"] = bull(hammer & (bot(0) <= l(1) + near(1)))
    p["CDLHANGINGMAN"] = bear(hammer & (bot(0) >= h(1) - near(1)))
    p["CDLHARAMI"] = against(is_long(1) & is_small(0) & inside_body(0, 1), 1)
    p["CDLHARAMICROSS"] = against(is_long(1) & is_doji(0) & inside_body(0, 1), 1)
    p["CDLHIGHWAVE"] = by_color(is_short(0) & (upper(0) > body(0) * 2.0) & (lower(0) > body(0) * 2.0))
    inside = (h(1) < h(2)) & (l(1) > l(2))
    broke_low, broke_high = (h(0) < h(1)) & (l(0) < l(1)), (h(0) > h(1)) & (l(0) > l(1))
    p["CDLHIKKAKE"] = _confirmed(either(inside & broke_low, inside & broke_high))
    nested = inside & (h(2) < h(3)) & (l(2) > l(3))
    p["CDLHIKKAKEMOD"] = _confirmed(either(
        nested & broke_low & (c(2) <= l(2) + near(2)), nested & broke_high & (c(2) >= h(2) - near(2))))
    p["CDLHOMINGPIGEON"] = bull(black(1) & black(0) & is_long(1) & is_small(0) & (o(0) < o(1)) & (c(0) > c(1)))
    p["CDLIDENTICAL3CROWS"] = bear(
        three_black & no_lower(2) & no_lower(1) & no_lower(0) & (c(2) > c(1)) & (c(1) > c(0))
        & within(o(1), c(2), equal(2)) & within(o(0), c(1), equal(1)))
    neck = black(1) & is_long(1) & white(0) & (o(0) < l(1))
    p["CDLINNECK"] = bear(neck & (c(0) <= c(1) + equal(1)) & (c(0) >= c(1)))
    shooting = is_short(0) & (upper(0) > body(0)) & no_lower(0)
    p["CDLINVERTEDHAMMER"] = bull(shooting & gap_down(0, 1))
    kick = opposite(1, 0) & _marubozu(1) & _marubozu(0) & ((black(1) & full_gap_up(0, 1)) | (white(1) & full_gap_down(0, 1)))
    p["CDLKICKING"] = by_color(kick)
    longer = body(0) > body(1)
    p["CDLKICKINGBYLENGTH"] = either(
        kick & ((longer & white(0)) | (~longer & white(1))), kick & ((longer & black(0)) | (~longer & black(1))))
    p["CDLLADDERBOTTOM"] = bull(
        black(4) & black(3) & black(2) & (o(4) > o(3)) & (o(3) > o(2)) & (c(4) > c(3)) & (c(3) > c(2)) & black(1)
        & (upper(1) > tiny(1)) & white(0) & (o(0) > o(1)) & (c(0) > h(1)))
    p["CDLLONGLEGGEDDOJI"] = bull(is_doji(0) & ((lower(0) > body(0)) | (upper(0) > body(0))))
    p["CDLLONGLINE"] = by_color(is_long(0) & (upper(0) < short_shadow(0)) & (lower(0) < short_shadow(0)))
    p["CDLMARUBOZU"] = by_color(_marubozu(0))
    p["CDLMATCHINGLOW"] = bull(black(1) & black(0) & within(c(0), c(1), equal(1)))
    hold = c(4) - body(4) * 0.5
    p["CDLMATHOLD"] = bull(
        is_long(4) & is_short(3) & is_short(2) & is_short(1) & white(4) & black(3) & white(0) & gap_up(3, 4)
        & (bot(2) < c(4)) & (bot(1) < c(4)) & (bot(2) > hold) & (bot(1) > hold) & (top(2) < o(3)) & (top(1) < top(2))
        & (o(0) > c(1)) & (c(0) > greatest(h(3), h(2), h(1))))
    p["CDLMORNINGDOJISTAR"] = bull(morning & is_doji(1))
    p["CDLMORNINGSTAR"] = bull(morning & is_small(1))
    p["CDLONNECK"] = bear(neck & within(c(0), l(1), equal(1)))
    p["CDLPIERCING"] = bull(neck & is_long(0) & (c(0) < o(1)) & (c(0) > c(1) + body(1) * 0.5))
    middle = l(0) + RANGE / 2.0
    p["CDLRICKSHAWMAN"] = bull(
        is_doji(0) & (lower(0) > body(0)) & (upper(0) > body(0)) & (bot(0) <= middle + near(0)) & (top(0) >= middle - near(0)))
    methods = is_long(4) & is_short(3) & is_short(2) & is_short(1) & is_long(0) & opposite(4, 3) & same(3, 2) & same(2, 1) & opposite(1, 0)
    for k in (3, 2, 1):
        methods = methods & (bot(k) < h(4)) & (top(k) > l(4))
    p["CDLRISEFALL3METHODS"] = either(
        methods & white(4) & (c(2) < c(3)) & (c(1) < c(2)) & (o(0) > c(1)) & (c(0) > c(4)),
        methods & black(4) & (c(2) > c(3)) & (c(1) > c(2)) & (o(0) < c(1)) & (c(0) < c(4)))
    sep = opposite(1, 0) & within(o(0), o(1), equal(1)) & is_long(0)
    p["CDLSEPARATINGLINES"] = either(sep & white(0) & no_lower(0), sep & black(0) & no_upper(0))
    p["CDLSHOOTINGSTAR"] = bear(shooting & gap_up(0, 1))
    p["CDLSHORTLINE"] = by_color(is_short(0) & (upper(0) < short_shadow(0)) & (lower(0) < short_shadow(0)))
    p["CDLSPINNINGTOP"] = by_color(is_short(0) & (upper(0) > body(0)) & (lower(0) > body(0)))
    p["CDLSTALLEDPATTERN"] = bear(
        three_white & star2 & is_long(1) & no_upper(1) & _opens_in_body(1, 2, False) & is_short(0) & (o(0) >= c(1) - body(0) - near(1)))
    p["CDLSTICKSANDWICH"] = bull(black(2) & white(1) & black(0) & (l(1) > c(2)) & within(c(0), c(2), equal(2)))
    p["CDLTAKURI"] = bull(is_doji(0) & no_upper(0) & (lower(0) > body(0) * 2.0))
    alike = absx(body(1) - body(0)) < near(1)
    p["CDLTASUKIGAP"] = either(
        gap_up(1, 2) & white(1) & black(0) & (o(0) < c(1)) & (o(0) > o(1)) & (c(0) < o(1)) & (c(0) > top(2)) & alike,
        gap_down(1, 2) & black(1) & white(0) & (o(0) < o(1)) & (o(0) > c(1)) & (c(0) > o(1)) & (c(0) < bot(2)) & alike)
    p["CDLTHRUSTING"] = bear(neck & (c(0) > c(1) + equal(1)) & (c(0) <= c(1) + body(1) * 0.5))
    dojis = (body(2) <= doji_size(2)) & (body(1) <= doji_size(2)) & (body(0) <= doji_size(2))
    p["CDLTRISTAR"] = either(dojis & gap_down(1, 2) & (bot(0) > bot(1)), dojis & gap_up(1, 2) & (top(0) < top(1)))
    p["CDLUNIQUE3RIVER"] = bull(
        star2 & black(2) & black(1) & (c(1) > c(2)) & (o(1) <= o(2)) & (l(1) < l(2)) & is_short(0) & white(0) & (o(0) > l(1)))
    p["CDLUPSIDEGAP2CROWS"] = bear(
        white(2) & star2 & black(1) & is_small(1) & gap_up(1, 2) & black(0) & (o(0) > o(1)) & (c(0) < c(1)) & (c(0) > c(2)))
    xside = same(2, 1) & opposite(1, 0) & (o(0) < top(1)) & (o(0) > bot(1)) & (c(0) < top(2)) & (c(0) > bot(2))
    p["CDLXSIDEGAP3METHODS"] = either(xside & white(2) & gap_up(1, 2), xside & black(2) & gap_down(1, 2))
    return p
