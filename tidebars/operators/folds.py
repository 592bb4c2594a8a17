"""State rules: parabolic stop, cycle filters, cool-down, average-cost positions."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from tidebars.plans.layout import Laid
from tidebars.plans.scan import chunk_fold

NAN = float("nan")


# --- parabolic stop --------------------------------------------------------------
def _psar_step(state, x, accel, limit):
    """state: bars seen, side, stop for the next bar, extreme, factor, last high, last low"""
    n, side, sar, ep, af, ph, pl = state
    hs, ls = x["high"].tolist(), x["low"].tolist()
    out, sides = [NAN] * len(hs), [NAN] * len(hs)
    for i, (h, l) in enumerate(zip(hs, ls)):
        if n == 0:
            n, ph, pl = 1, h, l
            continue
        if n == 1:
            down = pl - l
            side = -1.0 if down > h - ph and down > 0 else 1.0
            ep, sar, af = (h, pl, accel) if side > 0 else (l, ph, accel)
            ph, pl, n = h, l, 2
        # rising side as is; falling side mirrored
        lo, hi, plo, phi = (l, h, pl, ph) if side > 0 else (-h, -l, -ph, -pl)
        s, e = side * sar, side * ep
        if lo <= s:  # turned: the stop becomes the extreme of the old side
            side = -side
            s, e = -max(e, phi, hi), -lo
            out[i], sides[i] = side * s, side
            af = accel
            lo, plo = -hi, -phi
        else:
            out[i], sides[i] = side * s, side
            if hi > e:
                e = hi
                af = min(af + accel, limit)
        s = min(s + af * (e - s), plo, lo)
        sar, ep, ph, pl = side * s, side * e, h, l
    return [n, side, sar, ep, af, ph, pl], {"sar": np.array(out), "side": np.array(sides)}


def parabolic(laid: Laid, accel: float = 0.02, limit: float = 0.2, keep=None) -> DataFrame:
    """Stop level and side (+1 under price, -1 above) of every bar."""
    step = partial(_psar_step, accel=accel, limit=limit)
    return chunk_fold(laid, step, [0.0] * 7, ["high", "low"], ["sar", "side"], keep)


# --- cycle filters ------------------------------------------------------------------
CYCLE_OUTPUTS = [
    "trendline", "dc_period", "dc_phase", "inphase", "quadrature", "sine", "leadsine", "trendmode", "mama", "fama",
]
_SERIES = ["smooth", "det", "q1", "i1"]          # the last 7 values of each
_SCALARS = ["i2", "q2", "re", "im", "period", "smoothed", "phase", "mphase", "mama", "fama", "sine", "lead", "days", "seen", "t1", "t2", "t3"]
_DEPTH = 51                                       # prices and smooth values a dominant cycle can span


def cycle_init():
    return [0.0] * (7 * len(_SERIES) + len(_SCALARS) + 2 * _DEPTH)


def _transform(v, gain):
    """Hilbert kernel on the last 7 values, newest first."""
    return (0.0962 * v[0] + 0.5769 * v[2] - 0.5769 * v[4] - 0.0962 * v[6]) * gain


def _cycle_step(state, x, fast, slow):
    state = list(state)
    hist = {n: state[7 * i : 7 * i + 7] for i, n in enumerate(_SERIES)}
    at = 7 * len(_SERIES)
    s = dict(zip(_SCALARS, state[at : at + len(_SCALARS)]))
    prices = state[at + len(_SCALARS) : at + len(_SCALARS) + _DEPTH]
    smooths = state[at + len(_SCALARS) + _DEPTH :]
    out = {o: [] for o in CYCLE_OUTPUTS}
    for p in x["close"].tolist():
        prices = [p] + prices[:-1] if s["seen"] else [p] * _DEPTH
        if not s["seen"]:
            s["mama"] = s["fama"] = s["t1"] = s["t2"] = s["t3"] = p
        s["seen"] += 1
        smooth = (4 * prices[0] + 3 * prices[1] + 2 * prices[2] + prices[3]) / 10.0
        smooths = [smooth] + smooths[:-1] if s["seen"] > 1 else [smooth] * _DEPTH
        gain = 0.075 * s["period"] + 0.54
        push = lambda n, v: hist.__setitem__(n, [v] + hist[n][:-1])
        push("smooth", smooth)
        push("det", _transform(smooths, gain) if s["seen"] > 6 else 0.0)
        push("q1", _transform(hist["det"], gain))
        push("i1", hist["det"][3])
        i1, q1 = hist["i1"][0], hist["q1"][0]
        ji, jq = _transform(hist["i1"], gain), _transform(hist["q1"], gain)
        i2, q2 = 0.2 * (i1 - jq) + 0.8 * s["i2"], 0.2 * (q1 + ji) + 0.8 * s["q2"]
        s["re"] = 0.2 * (i2 * s["i2"] + q2 * s["q2"]) + 0.8 * s["re"]
        s["im"] = 0.2 * (i2 * s["q2"] - q2 * s["i2"]) + 0.8 * s["im"]
        s["i2"], s["q2"] = i2, q2
        old = s["period"]
        per = 2 * math.pi / math.atan(s["im"] / s["re"]) if s["im"] != 0 and s["re"] != 0 else old
        per = min(max(per, 0.67 * old), 1.5 * old) if old else per
        per = min(max(per, 6.0), 50.0)
        s["period"] = 0.2 * per + 0.8 * old
        s["smoothed"] = 0.33 * s["period"] + 0.67 * s["smoothed"]
        # adaptive means
        mphase = math.degrees(math.atan(q1 / i1)) if i1 != 0 else 0.0
        turn = max(s["mphase"] - mphase, 1.0)
        s["mphase"] = mphase
        alpha = max(fast / turn, slow) if turn > 1.0 else fast
        s["mama"] = alpha * p + (1 - alpha) * s["mama"]
        s["fama"] = 0.5 * alpha * s["mama"] + (1 - 0.5 * alpha) * s["fama"]
        # dominant cycle phase over whole bars
        n = min(max(int(s["smoothed"] + 0.5), 1), _DEPTH - 1)
        real = sum(math.sin(2 * math.pi * i / n) * smooths[i] for i in range(n))
        imag = sum(math.cos(2 * math.pi * i / n) * smooths[i] for i in range(n))
        phase = math.degrees(math.atan(real / imag)) if abs(imag) > 1e-9 else math.copysign(90.0, real) if real else 0.0
        phase += 90.0 + (360.0 / s["smoothed"] if s["smoothed"] else 0.0)
        if imag < 0:
            phase += 180.0
        if phase > 315.0:
            phase -= 360.0
        sine, lead = math.sin(math.radians(phase)), math.sin(math.radians(phase + 45.0))
        mean = sum(prices[:n]) / n
        line = (4 * mean + 3 * s["t1"] + 2 * s["t2"] + s["t3"]) / 10.0
        s["t1"], s["t2"], s["t3"] = mean, s["t1"], s["t2"]
        trend = 1.0
        if (sine > lead and s["sine"] <= s["lead"]) or (sine < lead and s["sine"] >= s["lead"]):
            s["days"], trend = 0.0, 0.0
        s["days"] += 1
        if s["days"] < 0.5 * s["smoothed"]:
            trend = 0.0
        moved = phase - s["phase"]
        if s["smoothed"] and 0.67 * 360 / s["smoothed"] < moved < 1.5 * 360 / s["smoothed"]:
            trend = 0.0
        if line and abs((smooth - line) / line) >= 0.015:
            trend = 1.0
        s["days"] = min(s["days"], 1000.0)
        s["phase"], s["sine"], s["lead"] = phase, sine, lead
        row = (line, s["smoothed"], phase, i1, q1, sine, lead, trend, s["mama"], s["fama"])
        ready = s["seen"] > 63
        for o, v in zip(CYCLE_OUTPUTS, row):
            out[o].append(v if ready or (o in ("mama", "fama", "dc_period", "inphase", "quadrature") and s["seen"] > 32) else NAN)
        s["seen"] = min(s["seen"], 64.0)
    flat = [v for n in _SERIES for v in hist[n]] + [s[n] for n in _SCALARS] + prices + smooths
    return flat, {o: np.array(v) for o, v in out.items()}


def cycles(laid: Laid, fast: float = 0.5, slow: float = 0.05, keep=None) -> DataFrame:
    """Hilbert cycle measures and phase-adaptive means of the close."""
    step = partial(_cycle_step, fast=fast, slow=slow)
    return chunk_fold(laid, step, cycle_init(), ["close"], CYCLE_OUTPUTS, keep, warm=512, tol=1e-9)


# --- cool-down --------------------------------------------------------------------------
def _cooldown_step(state, x, gap):
    last = state[0]
    hit, seq = x["hit"] == 1.0, x["seq"]
    out = np.zeros(len(seq))
    for i in np.flatnonzero(hit):
        if last < 0 or seq[i] - last >= gap:
            out[i], last = 1.0, seq[i]
    # A signal too old to hold back the next chunk is the same state as none.
    if len(seq) and last >= 0 and seq[-1] + 1 - last >= gap:
        last = -1.0
    return [last], {"signal": out}


def cooldown(laid: Laid, gap: int = 10, keep=None) -> DataFrame:
    """Signals of column ``hit`` (0/1) with at least ``gap`` bars between two."""
    return chunk_fold(laid, partial(_cooldown_step, gap=gap), [-1.0], ["hit"], ["signal"], keep, warm=max(4 * gap, 64))


# --- greedy non-overlap ---------------------------------------------------------------------
def _greedy_step(state, x):
    last = state[0]
    seq, exit_ = x["seq"], x["exit_seq"]
    out = np.zeros(len(seq))
    for i in np.flatnonzero(~np.isnan(exit_)):
        if seq[i] > last:
            out[i], last = 1.0, exit_[i]
    # A trade that is over at the end of the chunk is the same state as none.
    if len(seq) and last <= seq[-1]:
        last = -1.0
    return [last], {"kept": out}


def non_overlapping(laid: Laid, keep=None) -> DataFrame:
    """Candidates (``exit_seq`` set) kept in entry order when they start after the
    exit of the last kept one."""
    return chunk_fold(laid, _greedy_step, [-1.0], ["exit_seq"], ["kept"], keep)


# --- positions with a running cost --------------------------------------------------------------
def _double_down_step(state, x, stake):
    """shares, cost: buy on each fall, sell all above the average cost"""
    shares, cost, prev = state
    sig = np.zeros(len(x["close"]))
    avg = np.full(len(sig), NAN)
    for i, p in enumerate(x["close"].tolist()):
        if prev and p < prev:
            shares, cost, sig[i] = shares + stake, cost + stake * p, 1.0
        elif shares and p > cost / shares:
            shares, cost, sig[i] = 0.0, 0.0, -1.0
        avg[i] = cost / shares if shares else NAN
        prev = p
    return [shares, cost, prev], {"signal": sig, "average_cost": avg}


def double_down(laid: Laid, stake: float = 1.0, keep=None) -> DataFrame:
    return chunk_fold(laid, partial(_double_down_step, stake=stake), [0.0, 0.0, 0.0], ["close"], ["signal", "average_cost"], keep)


def _scale_in_step(state, x, amount, drop):
    """size, cost: add a slice whenever the price is ``drop`` or more under the average entry"""
    size, cost = state
    sig = np.zeros(len(x["close"]))
    avg = np.full(len(sig), NAN)
    for i, p in enumerate(x["close"].tolist()):
        if size == 0 or (cost / size - p) / (cost / size) >= drop:
            size, cost, sig[i] = size + amount, cost + amount * p, 1.0
        avg[i] = cost / size if size else NAN
    return [size, cost], {"signal": sig, "average_cost": avg}


def scale_in(laid: Laid, amount: float = 0.1, drop: float = 0.02, keep=None) -> DataFrame:
    step = partial(_scale_in_step, amount=amount, drop=drop)
    return chunk_fold(laid, step, [0.0, 0.0], ["close"], ["signal", "average_cost"], keep)


def _martingale_step(state, x, stake, most):
    """size, losing run, last close: double after a losing bar, reset after a winning one"""
    size, run, prev = state
    sizes, pnl = np.zeros(len(x["close"])), np.zeros(len(x["close"]))
    for i, p in enumerate(x["close"].tolist()):
        if prev:
            gain = (p - prev) * (size or stake)
            pnl[i] = gain
            if gain < 0 and run < most:
                size, run = (size or stake) * 2, run + 1
            else:
                size, run = stake, 0.0
        else:
            size = stake
        sizes[i], prev = size, p
    return [size, run, prev], {"size": sizes, "pnl": pnl}


def martingale(laid: Laid, stake: float = 1.0, max_trades: int = 10, keep=None) -> DataFrame:
    step = partial(_martingale_step, stake=stake, most=max_trades)
    return chunk_fold(laid, step, [0.0, 0.0, 0.0], ["close"], ["size", "pnl"], keep)
