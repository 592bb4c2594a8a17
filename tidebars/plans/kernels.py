"""Array evaluation of recurrences inside one chunk (runs in Arrow batches)."""

from __future__ import annotations

import math

import numpy as np


def decay_scan(q: float, b: np.ndarray) -> np.ndarray:
    """y[t] = q*y[t-1] + b[t], starting at the first value of b.

    Within a block the recurrence is a running sum of b / q**t; blocks are short
    enough for the powers to stay in range.
    """
    gap = np.isnan(b)
    start = int(np.argmin(gap)) if len(b) else 0
    out = np.full(len(b), np.nan)
    if len(b) == 0 or gap[start]:
        return out
    if gap[start:].any():
        # A missing value changes nothing: the last result stays.
        out[start:] = decay_scan(q, b[start:][~gap[start:]])[np.cumsum(~gap[start:]) - 1]
        return out
    if q <= 0.0:
        out[start:] = b[start:]
        return out
    size = max(16, min(len(b), int(500.0 / -math.log(q))))
    power = q ** np.arange(size, dtype=float)
    carry = 0.0
    for lo in range(start, len(b), size):
        part = b[lo : lo + size]
        w = power[: len(part)]
        y = w * (np.cumsum(part / w) + carry * q)
        out[lo : lo + len(part)] = y
        carry = y[-1]
    return out


def general_scan(a, a2: float, b: np.ndarray) -> np.ndarray:
    """y[t] = a[t]*y[t-1] + a2*y[t-2] + b[t]; the last result stays over missing values.

    Blocks of bars run side by side: a first pass finds what each block does to its two start values (a map of two by two
    and a shift), the maps are chained block by block, and a second pass runs all blocks from their true start values."""
    out = np.full(len(b), np.nan)
    factors = np.broadcast_to(np.asarray(a, dtype=float), b.shape)
    if not len(b) or np.isnan(b).all():
        return out
    start = int(np.argmin(np.isnan(b)))
    known = ~(np.isnan(b[start:]) | np.isnan(factors[start:]))
    at = np.cumsum(known) - 1
    y = _affine_blocks(factors[start:][known], a2, b[start:][known])
    out[start:] = np.where(at < 0, 0.0, y[np.maximum(at, 0)] if len(y) else 0.0)
    return out


def _affine_blocks(a: np.ndarray, a2: float, b: np.ndarray) -> np.ndarray:
    n = len(b)
    size = max(1, math.isqrt(n))
    blocks = -(-n // size) if n else 0
    # One row for each place in a block, one column for each block; what fills up the last block comes after the end.
    fill = lambda x: np.ascontiguousarray(np.r_[x, np.zeros(blocks * size - n)].reshape(blocks, size).T)
    a, b = fill(a), fill(b)
    # Columns of the pairs: from (1, 0) without shifts, from (0, 1) without shifts, from (0, 0) with shifts.
    now, before = np.zeros((3, blocks)), np.zeros((3, blocks))
    now[0] = before[1] = 1.0
    shift = np.zeros((3, blocks))
    for t in range(size):
        shift[2] = b[t]
        now, before = a[t] * now + a2 * before + shift, now
    y1, y2 = np.zeros(blocks), np.zeros(blocks)
    for k, (p, q, r, s, u, v) in enumerate(zip(*now[:, : blocks - 1].tolist(), *before[:, : blocks - 1].tolist())):
        y1[k + 1] = p * y1[k] + q * y2[k] + r
        y2[k + 1] = s * y1[k] + u * y2[k] + v
    out = np.empty((size, blocks))
    for t in range(size):
        y1, y2 = a[t] * y1 + a2 * y2 + b[t], y1
        out[t] = y1
    return out.T.ravel()[:n]


def start_value(fn: str, x: np.ndarray, seq: np.ndarray, n: int, start: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    at = np.flatnonzero(seq == start)
    if len(at) and at[0] >= n - 1:
        part = x[at[0] - n + 1 : at[0] + 1]
        out[at[0]] = part.mean() if fn == "avg" else part.sum()
    return out


_BIN = {
    "add": np.add, "sub": np.subtract, "mul": np.multiply,
    "gt": np.greater, "ge": np.greater_equal, "lt": np.less, "le": np.less_equal,
    "eq": np.equal, "ne": np.not_equal,
}
_UN = {
    "neg": np.negative, "abs": np.abs, "exp": np.exp, "sign": np.sign, "floor": np.floor,
    "sin": np.sin, "cos": np.cos, "tanh": np.tanh, "atan": np.arctan,
}
COMPARE = {"gt", "ge", "lt", "le", "eq", "ne"}


def scalar(op, args, vals):
    """One scalar operator over float arrays; NaN is null, truth is 1.0 / 0.0."""
    if op in _BIN:
        x, y = vals
        out = _BIN[op](x, y)
        if op in COMPARE:
            return np.where(np.isnan(x) | np.isnan(y), np.nan, out.astype(float))
        return out
    if op in _UN:
        return _UN[op](vals[0])
    if op == "div":
        return np.divide(vals[0], np.where(vals[1] == 0, np.nan, vals[1]))
    if op in ("log", "log10", "sqrt"):
        x = np.where(vals[0] > 0, vals[0], np.nan) if op != "sqrt" else np.where(vals[0] >= 0, vals[0], np.nan)
        return getattr(np, op)(x)
    if op == "pow":
        return np.power(vals[0], args[1])
    if op == "known":
        return vals[0]
    if op in ("greatest", "least"):
        fn = np.fmax if op == "greatest" else np.fmin
        out = vals[0]
        for v in vals[1:]:
            out = fn(out, v)
        return out
    if op == "coalesce":
        out = vals[0]
        for v in vals[1:]:
            out = np.where(np.isnan(out), v, out)
        return out
    if op == "isnull":
        return np.isnan(vals[0]).astype(float)
    if op == "true":
        return np.where(vals[0] == 1.0, 1.0, 0.0)
    if op == "not":
        return 1.0 - vals[0]
    if op == "and":
        x, y = vals
        return np.where((x == 0) | (y == 0), 0.0, x * y)
    if op == "or":
        x, y = vals
        return np.where((x == 1) | (y == 1), 1.0, x * y)
    if op == "case":
        out = vals[-1]
        pairs = list(zip(vals[0:-1:2], vals[1:-1:2]))
        for cond, v in reversed(pairs):
            out = np.where(cond == 1.0, v, out)
        return out
    raise KeyError(op)
