"""Technical indicators as feature expressions.

Names and lengths of :func:`catalogue` follow the common indicator library's
defaults; each value is null during its warm-up.
"""

from __future__ import annotations

import math

from tidebars.functions.expr import (
    C, H, L, O, SEQ, V, absx, coalesce, diff, ema, ema_alpha, ex, fill0, glob, greatest, known, lag, least, log10x, logx, mad,
    memory, pct, recur, rmax, rmin, roll, rstd, rstdp, rsum, run, sma, sqrtx, start_value, when, wilder, wilder_sum, wma,
)

TYP = (H + L + C) / 3.0
MED = (H + L) / 2.0


def solid(x):
    """A value whose null bars are known: nulls of unknown place become 0."""
    x = ex(x)
    return x if x.lead is not None else known(fill0(x), 0)


def after(x, n):
    """Null on the first ``n - 1`` bars."""
    return known(when(SEQ >= n - 1, ex(x)), n - 1)


def ema_from(x, n, start):
    """Exponential mean seeded with the mean of the n values ending at bar ``start``."""
    b = when(SEQ.eq(start), start_value("avg", x, n, start), SEQ > start, ex(x) * (2.0 / (n + 1)))
    q = 1.0 - 2.0 / (n + 1)
    return recur(q, b, memory(q), start)


def ema_ta(x, n):
    """First-value seed, null until n bars exist."""
    x = ex(x)
    e = ema(x, n)
    return after(e, e.lead + n) if e.lead is not None else e


# --- moving averages ----------------------------------------------------------
def dema(x, n):
    e1 = ema(x, n, "sma")
    return e1 * 2.0 - ema(e1, n, "sma")


def tema(x, n, seed="sma"):
    e1 = ema(x, n, seed)
    e2 = ema(e1, n, seed)
    return e1 * 3.0 - e2 * 3.0 + ema(e2, n, seed)


def t3(x, n=5, v=0.7):
    e = [ema(x, n, "sma")]
    for _ in range(5):
        e.append(ema(e[-1], n, "sma"))
    c1, c2, c3, c4 = -(v**3), 3 * v * v + 3 * v**3, -6 * v * v - 3 * v - 3 * v**3, 1 + 3 * v + v**3 + 3 * v * v
    return e[5] * c1 + e[4] * c2 + e[3] * c3 + e[2] * c4


def trima(x, n):
    a, b = ((n + 1) // 2,) * 2 if n % 2 else (n // 2, n // 2 + 1)
    return sma(sma(x, a), b)


def hma(x, n):
    return wma(wma(x, n // 2) * 2.0 - wma(x, n), int(math.sqrt(n)))


def efficiency(x, n):
    """Net change over path length; 1 for a flat path of no length."""
    path = rsum(absx(diff(x)), n)
    return when(path > 0.0, absx(diff(x, n)) / path, otherwise=1.0)


def kama(x, n=10, fast=2, slow=30):
    """Adaptive mean: the factor follows the efficiency ratio, the start is the close before."""
    x = ex(x)
    lo, hi = 2.0 / (slow + 1), 2.0 / (fast + 1)
    sc = (efficiency(x, n) * (hi - lo) + lo)
    sc = sc * sc
    s = x.lead + n - 1
    sc = known(fill0(sc), 0)
    b = when(SEQ.eq(s), x, SEQ > s, sc * x)
    return recur(when(SEQ > s, 1.0 - sc, otherwise=0.0), b, memory(1.0 - lo * lo), s)


def frama(n=20, upper=8, lower=40):
    """Fractal adaptive mean of the close: the fractal dimension of two half windows sets a factor,
    whose length is then mapped to ``upper`` .. ``lower`` bars."""
    h = n // 2
    n1 = (rmax(H, h) - rmin(L, h)) / float(h)
    n2 = (lag(rmax(H, h), h) - lag(rmin(L, h), h)) / float(h)
    n3 = (rmax(H, n) - rmin(L, n)) / float(n)
    dim = (logx(n1 + n2) - logx(n3)) / math.log(2.0)
    from tidebars.functions.expr import expx

    raw = least(greatest(expx((dim - 1.0) * math.log(2.0 / (lower + 1))), 0.01), 1.0)
    length = ((2.0 - raw) / raw - 1.0) * ((lower - upper) / (lower - 1.0)) + float(upper)
    slowest = 2.0 / (lower + 1)
    a = known(coalesce(least(greatest(2.0 / (length + 1.0), slowest), 1.0), slowest), 0)
    s = n - 1
    b = when(SEQ.eq(s), C, SEQ > s, a * C)
    return recur(when(SEQ > s, 1.0 - a, otherwise=0.0), b, memory(1.0 - slowest), s)


def supersmoother(x, n=10):
    """Two-pole smoother (second-order recurrence)."""
    x = solid(x)
    a1 = math.exp(-1.414 * math.pi / n)
    b1 = 2 * a1 * math.cos(1.414 * math.pi / n)
    c2, c3 = b1, -a1 * a1
    c1 = 1 - c2 - c3
    s = x.lead + 1
    b = when(SEQ >= s, (x + lag(x)) * (c1 / 2.0))
    return recur(c2, b, 2 * memory(a1), s, c3)


def high_pass(x, n):
    """Two-pole high-pass filter of cut-off ``n``."""
    x = solid(x)
    w = 0.707 * 2 * math.pi / n
    al = (math.cos(w) + math.sin(w) - 1) / math.cos(w)
    s = x.lead + 2
    q = 1 - al
    b = when(SEQ >= s, (x - lag(x) * 2.0 + lag(x, 2)) * ((1 - al / 2) ** 2))
    return recur(2 * q, b, 3 * memory(abs(q)), s, -q * q)


def universal_oscillator(x, n=20):
    """Second-order high-pass filter of cut-off ``n``, standardised over the symbol."""
    x = solid(x)
    al = math.cos(math.sqrt(2.0) * math.pi / n) ** 2
    be = 1.0 - al
    s = x.lead + 2
    b = when(SEQ >= s, (x - lag(x) * 2.0 + lag(x, 2)) * ((1.0 - be / 2.0) * be))
    f = known(coalesce(recur(2.0 * al, b, 3 * memory(al), s, -al * al), 0.0), 0)
    return (f - glob("avg", f)) / glob("stddev_pop", f)


def moving_average(x, n, kind="simple"):
    kind = kind.lower()
    table = {
        "simple": sma, "sma": sma, "exponential": ema, "ema": ema, "weighted": wma, "wma": wma,
        "wilder": wilder, "hull": hma, "dema": dema, "tema": tema, "trima": trima, "kama": kama,
    }
    return table[kind](x, n)


# --- ranges, directional movement ------------------------------------------------
TR1 = greatest(H - L, absx(H - lag(C)), absx(L - lag(C)))
TRANGE = known(when(SEQ >= 1, TR1), 1)
TR0 = known(when(SEQ >= 1, TR1, otherwise=H - L), 0)


def atr(n=14):
    """Wilder mean of the true range, first true range on the second bar."""
    return wilder(TRANGE, n)


def atr0(n=14):
    """Wilder mean whose first true range is the first bar's high - low."""
    return wilder(TR0, n)


def atr_simple(n=14, need=None):
    return sma(TR0, n, need)


def _dm():
    up, dn = diff(H), lag(L) - L
    plus = known(when((up > dn) & (up > 0.0), up, SEQ >= 1, 0.0), 1)
    minus = known(when((dn > up) & (dn > 0.0), dn, SEQ >= 1, 0.0), 1)
    return plus, minus


def directional(n=14):
    plus, minus = _dm()
    tr = wilder_sum(TRANGE, n)
    pdm, mdm = wilder_sum(plus, n), wilder_sum(minus, n)
    pdi = known(when(SEQ >= n, pdm * 100.0 / tr), n)
    mdi = known(when(SEQ >= n, mdm * 100.0 / tr), n)
    total = pdi + mdi
    dx = known(when(total > 0.0, absx(pdi - mdi) * 100.0 / total, SEQ >= n, 0.0), n)
    return {"pdm": pdm, "mdm": mdm, "pdi": pdi, "mdi": mdi, "dx": dx, "adx": wilder(dx, n)}


def adx(n=14):
    return directional(n)["adx"]


# --- momentum -----------------------------------------------------------------
def _updown(x, first_zero):
    d = diff(x)
    s = ex(x).lead + 1
    up, dn = greatest(d, 0.0), greatest(-d, 0.0)
    if first_zero:
        return known(fill0(up), 0), known(fill0(dn), 0)
    return known(when(SEQ >= s, up), s), known(when(SEQ >= s, dn), s)


def rsi(n=14, x=C, kind="ta"):
    """Relative strength index.

    ``ta``: first-value seed; ``wilder``: mean-of-n seed; ``simple``: rolling means.
    """
    up, dn = _updown(x, kind != "wilder")
    if kind == "ta":
        g, d = ema_alpha(up, 1.0 / n), ema_alpha(dn, 1.0 / n)
        v = when(d.eq(0.0), 100.0, otherwise=100.0 - 100.0 / (1.0 + g / d))
        return after(v, n)
    if kind == "wilder":
        g, d = wilder(up, n), wilder(dn, n)
        return known(when((g + d) > 0.0, g * 100.0 / (g + d), SEQ >= n, 0.0), n)
    g, d = sma(up, n), sma(dn, n)
    return known(when(d.eq(0.0), 100.0, otherwise=100.0 - 100.0 / (1.0 + g / d)), n - 1)


def cmo(n=14):
    up, dn = _updown(C, False)
    g, d = wilder(up, n), wilder(dn, n)
    return when((g + d) > 0.0, (g - d) * 100.0 / (g + d), SEQ >= n, 0.0)


def cmo_sum(n=14):
    up, dn = _updown(C, True)
    g, d = rsum(up, n), rsum(dn, n)
    return (g - d) * 100.0 / (g + d)


def macd(fast=12, slow=26, sig=9, x=C):
    """First-value seeds, as exponential means of a data frame library."""
    line = ema(x, fast) - ema(x, slow)
    s = ema(line, sig)
    return line, s, line - s


def macd_lib(fast=12, slow=26, sig=9):
    """Both means seeded on the bar where the slow one starts."""
    line = ema_from(C, fast, slow - 1) - ema_from(C, slow, slow - 1)
    s = ema(line, sig, "sma")
    line = after(line, slow + sig - 1)
    return line, s, line - s


def ppo(fast=12, slow=26, sig=9):
    line = (ema(C, fast) - ema(C, slow)) * 100.0 / ema(C, slow)
    s = ema(known(fill0(line), 0), sig)
    return line, s, line - s


def tsi(slow=25, fast=13, x=C):
    d = known(fill0(diff(x)), 0)
    top = ema(ema(d, slow), fast)
    low = ema(ema(absx(d), slow), fast)
    return top * 100.0 / low


def stoch_k(n=14, x=C):
    return (x - rmin(L, n)) * 100.0 / (rmax(H, n) - rmin(L, n))


def flat_to(x, value):
    """Replace nulls of a zero-range division after the warm-up."""
    return coalesce(x, value)


def stochastic(k=14, smooth=3):
    raw = stoch_k(k)
    return raw, sma(raw, smooth)


def williams_r(n=14):
    return (rmax(H, n) - C) * -100.0 / (rmax(H, n) - rmin(L, n))


def cci(n=20, k=0.015):
    return (TYP - sma(TYP, n)) / (mad(TYP, n) * k)


def aroon(n=14):
    up = (float(n) - roll("age_max", H, n + 1)) * (100.0 / n)
    dn = (float(n) - roll("age_min", L, n + 1)) * (100.0 / n)
    return up, dn


def ultimate(a=7, b=14, c=28):
    low = least(L, lag(C))
    bp, tr = known(when(SEQ >= 1, C - low), 1), TRANGE
    part = lambda n: rsum(bp, n) / rsum(tr, n)
    return (part(a) * 4.0 + part(b) * 2.0 + part(c)) * (100.0 / 7.0)


def vortex(n=14):
    tr = rsum(TRANGE, n)
    return rsum(absx(H - lag(L)), n) / tr, rsum(absx(L - lag(H)), n) / tr


def kst(r=(10, 15, 20, 30), w=(10, 10, 10, 15), sig=9):
    total = None
    for i, (a, b) in enumerate(zip(r, w)):
        part = sma(pct(C, a), b) * (100.0 * (i + 1))
        total = part if total is None else total + part
    return total, sma(total, sig)


def dpo(n=20):
    return lag(C, n // 2 + 1) - sma(C, n)


def mass_index(fast=9, slow=25):
    e1 = ema(H - L, fast)
    e2 = ema(e1, fast)
    return rsum(known(coalesce(e1 / e2, 1.0), 0), slow)


def stc(slow=50, fast=23, cycle=10, smooth1=3, smooth2=3):
    """Schaff cycle: stochastic of MACD, smoothed, taken twice."""
    m = ema(C, fast) - ema(C, slow)

    def position(x):
        lo, hi = rmin(x, cycle), rmax(x, cycle)
        return known(fill0((x - lo) * 100.0 / (hi - lo)), 0)

    d = ema(position(m), smooth1)
    return ema(position(d), smooth2)


def awesome(fast=5, slow=34):
    return sma(MED, fast) - sma(MED, slow)


# --- bands ------------------------------------------------------------------------
def bollinger(n=20, k=2.0, pop=True, x=C):
    mid = sma(x, n)
    dev = (rstdp if pop else rstd)(x, n) * float(k)
    return mid + dev, mid, mid - dev


def keltner(n=20, n_atr=10, k=2.0):
    mid = sma(C, n)
    return mid + atr0(n_atr) * float(k), mid, mid - atr0(n_atr) * float(k)


def keltner_original(n=20):
    return sma((H * 4.0 - L * 2.0 + C) / 3.0, n), sma(TYP, n), sma((H * -2.0 + L * 4.0 + C) / 3.0, n)


def donchian(n=20):
    return rmax(H, n), rmin(L, n)


def zscore(n, x=C):
    return (x - sma(x, n)) / rstd(x, n)


# --- volume -------------------------------------------------------------------------
def close_location():
    return fill0(((C - L) - (H - C)) / (H - L))


def ad_line():
    return run("sum", close_location() * V)


def obv():
    """Starts at the first volume."""
    step = when(SEQ.eq(0), V, C > lag(C), V, C < lag(C), -V, otherwise=0.0)
    return run("sum", step)


def adosc(fast=3, slow=10):
    ad = ad_line()
    return after(ema(ad, fast) - ema(ad, slow), slow)


def cmf(n=20):
    return rsum(close_location() * V, n) / rsum(V, n)


def mfi(n=14):
    flow = TYP * V
    up = known(when(TYP > lag(TYP), flow, SEQ >= 1, 0.0), 1)
    dn = known(when(TYP < lag(TYP), flow, SEQ >= 1, 0.0), 1)
    total = rsum(up, n) + rsum(dn, n)
    return when(total > 0.0, rsum(up, n) * 100.0 / total, SEQ >= n, 0.0)


def efi(n=13):
    return ema(diff(C) * V, n, "sma")


def vwap_running():
    return run("sum", TYP * V) / run("sum", V)


def vwap_rolling(n):
    return rsum(C * V, n) / rsum(V, n)


def ease_of_movement(n=14):
    move = (diff(H) + diff(L)) * (H - L) / (V * 2.0) * 1e8
    return move, sma(known(fill0(move), 0), n)


def ulcer(n=14):
    drop = (C - rmax(C, n, 1)) * 100.0 / rmax(C, n, 1)
    drop = known(fill0(drop), 0)
    return sqrtx(rsum(drop * drop, n) / float(n))


def roc(n, x=C):
    return pct(x, n) * 100.0


# --- the catalogue ----------------------------------------------------------------
def catalogue() -> dict:
    """Every built-in and recurrence indicator, by output column."""
    ub, mb, lb = bollinger(20, 2.0)
    m = directional(14)
    line, sig, hist = macd_lib()
    up, dn = aroon(14)
    k5 = stoch_k(5)
    k5 = filled(k5, 4)
    slow_k = sma(k5, 3)
    r14 = rsi(14, kind="wilder")
    rk = when(rmax(r14, 5) > rmin(r14, 5), (r14 - rmin(r14, 5)) * 100.0 / (rmax(r14, 5) - rmin(r14, 5)), SEQ >= 18, 0.0)
    rk = known(rk, 18)
    e3 = ema(ema(ema(C, 30, "sma"), 30, "sma"), 30, "sma")
    s12, s26 = sma(C, 12), sma(C, 26)
    out = {
        "UPPERBAND": ub, "MIDDLEBAND": mb, "LOWERBAND": lb, "DEMA": dema(C, 30),
        **{f"EMA_{n}": ema(C, n, "sma") for n in (10, 20, 50, 200)},
        "KAMA": after(kama(C, 30), 31),
        **{f"MA_{n}": sma(C, n) for n in (10, 20, 50, 200)},
        "SMA": sma(C, 30), "T3": t3(C), "TEMA": tema(C, 30), "TRIMA": trima(C, 30), "WMA": wma(C, 30),
        "ADX": m["adx"], "ADXR": (m["adx"] + lag(m["adx"], 13)) / 2.0, "APO": s12 - s26,
        "AROON_DOWN": dn, "AROON_UP": up, "AROONOSC": up - dn,
        "BOP": fill0((C - O) / (H - L)), "CCI": cci(14), "CMO": cmo(14), "DX": m["dx"],
        "MACD": line, "MACDSIGNAL": sig, "MACDHIST": hist, "MFI": mfi(14),
        "MINUS_DI": m["mdi"], "MINUS_DM": m["mdm"], "MOM": diff(C, 10), "PLUS_DI": m["pdi"], "PLUS_DM": m["pdm"],
        "PPO": (s12 - s26) * 100.0 / s26, "ROC": roc(10), "ROCP": pct(C, 10), "ROCR": C / lag(C, 10),
        "ROCR100": C * 100.0 / lag(C, 10), "RSI": r14,
        "STOCH_K": after(slow_k, 9), "STOCH_D": sma(slow_k, 3), "STOCHF_K": after(k5, 7), "STOCHF_D": sma(k5, 3),
        "STOCHRSI_K": after(rk, 21), "STOCHRSI_D": sma(rk, 3), "TRIX": pct(e3) * 100.0, "ULTOSC": ultimate(),
        "WILLR": filled(williams_r(14), 13), "AD": ad_line(), "ADOSC": adosc(), "OBV": obv(),
        "ATR": atr(14), "NATR": atr(14) * 100.0 / C, "TRANGE": TRANGE,
        "AVGPRICE": (O + H + L + C) / 4.0, "MEDPRICE": MED, "TYPPRICE": TYP, "WCLPRICE": (H + L + C * 2.0) / 4.0,
        "rolling_mean": sma(C, 14), "rolling_std": rstd(C, 14), "z_score": zscore(14),
        "VWAP": vwap_running(), "HMA": hma(C, 10),
        "KELTNER_UPPER": sma(C, 20) + atr(10) * 2.0, "KELTNER_LOWER": sma(C, 20) - atr(10) * 2.0,
        "DONCHIAN_HIGH": rmax(H, 20), "DONCHIAN_LOW": rmin(L, 20), "EFI": efi(13), "SUPER_TREND": C - atr(14) * 2.0,
    }
    return out


def filled(x, first, value=0.0):
    """Null before bar ``first``; from there on, nulls become ``value``."""
    return known(when(SEQ >= first, coalesce(x, value)), first)


def catalogue_extra() -> dict:
    """Indicators that only the scoring side uses."""
    bh, bm, bl = bollinger(20, 2.0)
    kh, kc, kl = keltner_original(20)
    vp, vm = vortex(14)
    k, ks = kst()
    conv = (rmax(H, 9) + rmin(L, 9)) / 2.0
    base = (rmax(H, 26) + rmin(L, 26)) / 2.0
    pl, ps, ph = ppo()
    flag = lambda c: when(c, 1.0, otherwise=0.0)
    return {
        "BBH": bh, "BBL": bl, "BBM": bm, "BBHI": flag(C > bh), "BBLI": flag(C < bl),
        "KCC": kc, "KCH": kh, "KCL": kl, "KCHI": flag(C > kh), "KCLI": flag(C < kl),
        "DCL": rmin(L, 20), "DCH": rmax(H, 20), "DCM": (rmax(H, 20) + rmin(L, 20)) / 2.0,
        "DCHI": flag(C >= rmax(H, 20)), "DCLI": flag(C <= rmin(L, 20)),
        "UI": ulcer(14), "PLUS_VI": vp, "MINUS_VI": vm, "MASS_INDEX": mass_index(), "DPO": dpo(20),
        "KST": k, "KST_SIG": ks, "KST_DIFF": k - ks, "ICHIMOKU_CONV": conv, "ICHIMOKU_BASE": base,
        "ICHIMOKU_A": (conv + base) / 2.0, "ICHIMOKU_B": (rmax(H, 52) + rmin(L, 52)) / 2.0,
        "TSI": tsi(), "AO": awesome(), "PPO_SIGNAL": ps, "PPO_HIST": ph,
        "DR": pct(C) * 100.0, "DLR": logx(C / lag(C)) * 100.0, "CR": (C / run("first", C) - 1.0) * 100.0,
        "BODY_SMALL": flag(absx(C - O) < (H - L) * 0.1), "BODY_LONG": flag(absx(C - O) > (H - L) * 0.7),
        "BODY_SHORT": flag(absx(C - O) < (H - L) * 0.3),
    }


def microstructure() -> dict:
    """Spread, impact, illiquidity and intensity measures of one bar."""
    ret = pct(C)
    logret = logx(C / lag(C))
    dollars = C * V
    rng = H - L
    return {
        "spread_proxy": rng, "relative_spread": rng / ((H + L) / 2.0), "intraday_volatility": rng / O,
        "gap_volatility": absx(O - lag(C)) / lag(C), "volume_price_impact": absx(ret) / V, "dollar_volume": dollars,
        "close_location": coalesce((C - L) / rng, 0.5), "amihud": absx(ret) / dollars, "kyle_proxy": absx(C - O) / V,
        "order_toxicity": absx(C - O) / rng, "intraday_momentum": (C - O) / O,
        "std_ratio": rstd(logret, 10) / rstd(ret, 10), "trading_intensity": V / sma(V, 10),
        "choppiness": log10x(rsum(TR0, 14) / (rmax(H, 14) - rmin(L, 14))) * (100.0 / math.log10(14.0)),
    }
