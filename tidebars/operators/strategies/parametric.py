"""Rules by name with their parameters open: ``build("rsi", n=21, low=25)``.

Each entry gives the defaults and a builder; a parameter that is not one of
them is refused.  The builders return feature expressions like any other rule.
"""

from __future__ import annotations

from collections.abc import Callable

from tidebars.functions.expr import C, H, L, V, Expr, absx, cross_dn, cross_up, diff, ema, lag, ncol, pct, rmax, rmin, rstdp, rsum, signal, sma
from tidebars.operators import indicators as I
from tidebars.operators.strategies.means import crossing, event, state


def _mean(kind: str, x, n: int) -> Expr:
    return I.moving_average(x, n, kind)


def two_means(short, long, kind, form):
    """Two means of one kind: where one is above the other (state), where that starts (event), or the crosses."""
    return {"state": state, "event": event, "cross": crossing}[form](_mean(kind, C, short), _mean(kind, C, long))


def level(n, kind):
    return state(C, _mean(kind, C, n))


def rsi(n, low, high, trend):
    r = I.rsi(n)
    if trend:
        return signal((r < low) & (C > sma(C, trend)), (r > high) & (C < sma(C, trend)))
    return signal(r < low, r > high)


def bollinger(n, k, side):
    mid, dev = sma(C, n), rstdp(C, n) * float(k)
    return signal(C < mid - dev, C > mid + dev) if side == "reversal" else signal(C > mid + dev, C < mid - dev)


def channel(n, exit):
    """Break of the extremes of the n bars before; ``exit`` bars on the short side."""
    return signal(C > lag(rmax(H, n)), C < lag(rmin(L, exit)))


def macd(fast, slow, smooth):
    line = ema(C, fast) - ema(C, slow)
    return crossing(line, ema(line, smooth))


def stochastic(n, low, high):
    k = (C - rmin(L, n)) * 100.0 / (rmax(H, n) - rmin(L, n))
    return signal(cross_up(k, low), cross_dn(k, high))


def momentum(n, above):
    return signal(pct(C, n) > above, pct(C, n) < -above)


def efficiency_ratio(n, enter, leave):
    er = diff(C, n) / rsum(absx(diff(C)), n)
    return signal(cross_up(er, enter), cross_dn(er, leave))


def volume_surge(n, times):
    return signal((V > sma(V, n) * times) & (C > lag(C)), (V > sma(V, n) * times) & (C < lag(C)))


def universal_oscillator(n, mode):
    x = I.universal_oscillator(C, n)
    return crossing(x, 0.0) if mode == "trend_following" else signal(cross_dn(x, 0.0), cross_up(x, 0.0))


def pair(fast, slow, side, mode):
    """Ratio of the first to the second asset of a panel, by trend, reversion or pullback."""
    ratio = C / ncol("close_2")
    f, s = sma(ratio, fast), sma(ratio, slow)
    long = {
        "trend following": (cross_up(f, s), cross_dn(f, s)),
        "mean reversion": (cross_dn(ratio, f), cross_up(ratio, f)),
        "pullback": ((f < ratio) & (ratio < s), (f > ratio) & (ratio > s)),
    }
    short = {
        "trend following": (cross_dn(f, s), cross_up(f, s)),
        "mean reversion": (cross_up(ratio, f), cross_dn(ratio, f)),
        "pullback": (cross_up(ratio, f) & (ratio < s), cross_dn(ratio, f) & (ratio > s)),
    }
    return signal(*(long if side == "long" else short)[mode])


RULES: dict[str, tuple[dict, Callable[..., Expr]]] = {
    "two_means": ({"short": 50, "long": 200, "kind": "simple", "form": "event"}, two_means),
    "level": ({"n": 200, "kind": "simple"}, level),
    "rsi": ({"n": 14, "low": 30.0, "high": 70.0, "trend": None}, rsi),
    "bollinger": ({"n": 20, "k": 2.0, "side": "reversal"}, bollinger),
    "channel": ({"n": 20, "exit": 20}, channel),
    "macd": ({"fast": 12, "slow": 26, "smooth": 9}, macd),
    "stochastic": ({"n": 14, "low": 20.0, "high": 80.0}, stochastic),
    "momentum": ({"n": 14, "above": 0.0}, momentum),
    "efficiency_ratio": ({"n": 10, "enter": 0.5, "leave": 0.2}, efficiency_ratio),
    "volume_surge": ({"n": 20, "times": 1.5}, volume_surge),
    "universal_oscillator": ({"n": 20, "mode": "reversal"}, universal_oscillator),
    "pair": ({"fast": 13, "slow": 25, "side": "long", "mode": "trend following"}, pair),
}


def build(name: str, **params) -> Expr:
    defaults, make = RULES[name]
    unknown = params.keys() - defaults.keys()
    if unknown:
        raise TypeError(f"{name} has no parameter {', '.join(sorted(unknown))}; it has {', '.join(defaults)}")
    return make(**{**defaults, **params})
