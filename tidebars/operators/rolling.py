"""Windows that Spark's frames do slowly or not at all: order statistics, deviations and any function of a window.

Every chunk is read with the bars its windows reach back to, so results do not depend on
chunks.  A window holds the last n bars; one with a missing value, or fewer bars, gives null.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.expr import Expr, absx, logx, run, true, when
from tidebars.plans.features import add_features
from tidebars.plans.layout import Laid, with_halo

#: Values of windows that a task lays out at once.
CELLS = 1 << 20


def sliding_quantiles(x: np.ndarray, n: int, shares: list[float]) -> np.ndarray:
    """Linear quantiles of every window of n values, by a sorted window that one value enters and one leaves."""
    out = np.full((len(shares), len(x)), np.nan)
    places = [(int(s * (n - 1)), s * (n - 1) % 1.0) for s in shares]
    window: list[float] = []
    values = x.tolist()
    for i, v in enumerate(values):
        if v == v:
            insort(window, v)
        if i >= n and values[i - n] == values[i - n]:
            del window[bisect_left(window, values[i - n])]
        if i >= n - 1 and len(window) == n:
            for row, (k, part) in enumerate(places):
                out[row, i] = window[k] + (window[k + 1] - window[k]) * part if part else window[k]
    return out


def _windows(x: np.ndarray, n: int, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """fn over rows of windows, in blocks; windows with a missing value give none."""
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    view = np.lib.stride_tricks.sliding_window_view(x, n, axis=0)
    gap = np.isnan(x if x.ndim == 1 else x.sum(axis=1))
    whole = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(gap, n).sum(axis=1) == 0)
    step = max(1, CELLS // (n * (1 if x.ndim == 1 else x.shape[1])))
    for at in range(0, len(whole), step):
        rows = whole[at : at + step]
        out[rows + n - 1] = fn(view[rows])
    return out


def deviations(x: np.ndarray, n: int) -> np.ndarray:
    """Sample deviation of every window of n values: running sums of squares about a value of the window's own block."""
    out = np.full(len(x), np.nan)
    step = max(4 * n, 1024)
    for lo in range(0, max(len(x) - n + 1, 0), step):
        part = x[lo : lo + step + n - 1]
        gap = np.isnan(part)
        centred = np.where(gap, 0.0, part - (np.nanmean(part) if not gap.all() else 0.0))
        sums = [np.cumsum(np.r_[0.0, v]) for v in (centred, centred**2, gap.astype(float))]
        s, q, holes = (c[n:] - c[:-n] for c in sums)
        spread = np.maximum(q - s**2 / n, 0.0) / (n - 1)
        found = np.where(holes > 0, np.nan, np.sqrt(spread))
        # Where a window lies close together, far from the middle of its block, its own values decide.
        for at in np.flatnonzero((holes == 0) & (spread * n < 1e-6 * (sums[1][-1] / len(part) + s**2 / n))):
            found[at] = part[at : at + n].std(ddof=1)
        out[lo + n - 1 : lo + n - 1 + len(found)] = found
    return out


def _over_chunks(laid: Laid, columns: list[str], back: int, outputs: list[str], keep: list[str], compute: Callable[[list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    rows = laid.rows
    read = list(dict.fromkeys([*keep, "symbol", "chunk", "seq", "bars", *columns]))
    halo = with_halo(Laid(laid.df.select(*read), rows), back)

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        own = table.column("seq").to_numpy() // rows == table.column("chunk").to_numpy()
        found = compute([table.column(c).cast(pa.float64()).to_numpy() for c in columns])
        kept = table.select(keep)
        for name, v in zip(outputs, found):
            kept = kept.append_column(name, pa.array(v, from_pandas=True))
        return kept.filter(pa.array(own))

    kinds = ", ".join(f"`{c}` {laid.df.schema[c].dataType.simpleString()}" for c in keep)
    return halo.groupBy("symbol", "chunk").applyInArrow(one, kinds + "".join(f", `{o}` double" for o in outputs))


def rolling_quantiles(laid: Laid, column: str, windows: dict[str, tuple[int, float]], keep: list[str]) -> DataFrame:
    """keep and, by name, the linear quantile of the last n values; windows of one length are slid once."""

    def compute(x):
        by: dict[int, list[str]] = {}
        for name, (n, _) in windows.items():
            by.setdefault(n, []).append(name)
        done = {name: v for n, names in by.items() for name, v in zip(names, sliding_quantiles(x[0], n, [windows[m][1] for m in names]))}
        return [done[name] for name in windows]

    if any(n < 1 or not 0 <= s <= 1 for n, s in windows.values()):
        raise ValueError("a window holds one bar at least, a share lies in 0 .. 1")
    return _over_chunks(laid, [column], max(n for n, _ in windows.values()) - 1, list(windows), keep, compute)


def rolling_deviation(laid: Laid, column: str, n: int, name: str, keep: list[str]) -> DataFrame:
    """keep and the sample deviation of the last n values, at a cost that does not depend on n."""
    if n < 2:
        raise ValueError("a deviation needs two bars at least")
    return _over_chunks(laid, [column], n - 1, [name], keep, lambda x: [deviations(x[0], n)])


def rolling_apply(laid: Laid, columns: list[str], n: int, name: str, fn: Callable[[np.ndarray], np.ndarray], keep: list[str]) -> DataFrame:
    """keep and fn of the last n bars.  fn gets an array of windows, (windows, n) for one column and (windows, columns, n)
    for several, and returns one value for each window."""
    stack = lambda x: x[0] if len(x) == 1 else np.stack(x, axis=1)
    return _over_chunks(laid, columns, n - 1, [name], keep, lambda x: [_windows(stack(x), n, fn)])


def running_product(laid: Laid, x: Expr, name: str, keep: list[str]) -> DataFrame:
    """keep and the product of x over all bars so far, missing values left out (1 before the first).

    Signs, zeros and logarithms add up over chunks; the product is put together from their sums."""
    size = absx(x)
    sums = {"_zeros": run("sum", when(true(x.eq(0.0)), 1.0, otherwise=0.0)), "_signs": run("sum", when(true(x < 0.0), 1.0, otherwise=0.0)), "_logs": run("sum", when(true(size > 0.0), logx(size), otherwise=0.0))}
    sign = F.when(F.col("_signs") % 2 == 1, -1.0).otherwise(1.0)
    product = F.when(F.col("_zeros") > 0, F.lit(0.0)).otherwise(sign * F.exp("_logs"))
    return add_features(laid, sums, keep).select(*keep, product.alias(name))


def back_fill(laid: Laid, columns: list[str], keep: list[str], limit: int | None = None) -> DataFrame:
    """keep and the columns, each missing value replaced by the next known one, at most ``limit`` bars later."""
    mark = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("seq").alias("seq"), F.col(c).alias("v")))
    firsts = laid.df.groupBy("symbol", "chunk").agg(*[F.min(mark(c)).alias(f"_f{i}") for i, c in enumerate(columns)])
    after = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)  # one row per chunk
    later = firsts.select("symbol", "chunk", *[F.min(f"_f{i}").over(after).alias(f"_l{i}") for i in range(len(columns))])
    rest = Window.partitionBy("symbol", "chunk").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = laid.df.withColumns({f"_n{i}": F.last(mark(c), ignorenulls=True).over(rest) for i, c in enumerate(columns)}).join(later, ["symbol", "chunk"])
    out = []
    for i, c in enumerate(columns):
        hit = F.coalesce(f"_n{i}", f"_l{i}")
        near = F.lit(True) if limit is None else hit["seq"] - F.col("seq") <= limit
        out.append(F.when(near, hit["v"]).alias(c))
    return d.select(*[k for k in keep if k not in columns], *out)
