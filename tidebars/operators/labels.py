"""Hindsight labels: best later exits, optimal trades, close marks, targets."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.expr import C, H, L, V, absx, greatest, lag, lead, ncol, roll, run, signx, sma, when
from tidebars.operators import folds
from tidebars.operators.indicators import TR0
from tidebars.plans.features import add_features
from tidebars.plans.layout import Laid, lay_out, settle


def gates(laid: Laid, min_profit=0.0015, atr_mult=1.0, vol_mult=1.0) -> DataFrame:
    """Per bar: is the volume high enough to enter, and the profit a trade must reach.

    Both means take the rows that exist (14 for the range, 20 for the volume)."""
    feats = {
        "open_ok": V >= sma(V, 20, 1) * vol_mult,
        "need": greatest(sma(TR0, 14, 1) * atr_mult, min_profit),
    }
    return add_features(laid, feats, ["symbol", "chunk", "seq", "bars", "ts", "close", "volume"])


def best_later_exit(laid: Laid, side: str = "long", **limits) -> DataFrame:
    """For every bar the first bar with the best later price, if it pays enough.

    The best later close does not depend on the entry, so one backward running
    maximum replaces the search: within the chunk by window, beyond it by the
    maxima of the later chunks.
    """
    sign = 1.0 if side == "long" else -1.0
    base = settle(gates(laid, **limits).withColumn("_p", F.col("close") * sign), "gates")
    mark = F.struct(F.col("_p").alias("p"), (-F.col("seq")).alias("s"))
    tops = base.groupBy("symbol", "chunk").agg(F.max(mark).alias("_top"))
    after = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)  # one row per chunk
    tops = tops.select("symbol", "chunk", F.max("_top").over(after).alias("_later"))
    inside = Window.partitionBy("symbol", "chunk").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    j = base.join(tops, ["symbol", "chunk"]).withColumn("_here", F.max(mark).over(inside))
    j = j.withColumn("_best", F.greatest("_here", "_later"))
    profit = F.col("_best.p") - F.col("_p")
    ok = F.col("open_ok") & (profit >= F.col("need")) & (profit > 0)
    return j.select(
        "symbol", "chunk", "seq", "bars", "ts", "close",
        F.when(ok, (-F.col("_best.s")).cast("double")).alias("exit_seq"), F.when(ok, profit).alias("profit"),
    )


def truth_trades(laid: Laid, side: str = "long", **limits) -> DataFrame:
    """Best-exit candidates, kept greedily so that trades do not overlap."""
    cand = Laid(settle(best_later_exit(laid, side, **limits), "cand"), laid.rows)
    kept = folds.non_overlapping(cand, ["symbol", "seq", "ts", "exit_seq", "profit"])
    return kept.filter("kept = 1").select(
        "symbol", F.lit(side).alias("side"), F.col("seq").alias("entry_seq"), F.col("exit_seq").cast("long").alias("exit_seq"), "profit")


def _optimal_step(state, x):
    """One chunk of bars, last bar first.  state: the exits that can still be best, as a staircase of falling price
    (negative prices, worths, exits); the worth of an exit is its price and what the bars after it earn, less what the
    bars from here on earn.  Every gain lowers all worths, and an exit worth no more than any entry still to come is
    dropped, so a state forgets bars that are some good trades away."""
    k = len(state) // 3
    negp, worth, exits = (list(state[i * k : (i + 1) * k]) for i in range(3))
    p, need, ok, at, least = (x[c].tolist() for c in ("_p", "need", "_ok", "_at", "_least"))
    out = [np.nan] * len(p)
    for i, price in enumerate(p):
        gain = 0.0
        if ok[i] == 1.0:
            # highest worth among prices >= entry + need: worth rises as the price falls
            j = bisect_left(negp, -(price + need[i]) + 1e-15 * abs(price)) - 1
            while j + 1 < len(negp) and -negp[j + 1] - price >= need[i]:
                j += 1
            while j >= 0 and -negp[j] - price < need[i]:
                j -= 1
            if j >= 0 and worth[j] - price > 0.0:
                gain, out[i] = worth[j] - price, exits[j]
                worth = [w - gain for w in worth]
        # this bar as an exit: what remains after it is what the bars behind it earn
        w = price - gain
        j = bisect_left(negp, -price)
        if j == 0 or worth[j - 1] <= w:
            end = j
            while end < len(negp) and worth[end] <= w:
                end += 1
            negp[j:end], worth[j:end], exits[j:end] = [-price], [w], [at[i]]
        dead = len(worth) if np.isnan(least[i]) else bisect_right(worth, least[i])
        if dead:
            del negp[:dead], worth[:dead], exits[:dead]
    return negp + worth + exits, {"exit_seq": np.array(out)}


def optimal_trades(laid: Laid, side: str = "long", warm: int = 512, max_rounds: int | None = None, **limits) -> DataFrame:
    """Non-overlapping trades with the largest total profit.

    Backwards, each bar needs the exits that can still be best.  All chunks start at once from what the ``warm`` bars
    behind them leave, and only those whose guess was wrong run again; the trades follow by a forward greedy pass."""
    sign = 1.0 if side == "long" else -1.0
    g = gates(laid, **limits).withColumn("_p", F.col("close") * sign).withColumn("_ok", F.col("open_ok").cast("double"))
    base = Laid(settle(g, "gates"), laid.rows)
    entry = when(ncol("_ok").eq(1.0), ncol("_p"))
    low = add_features(base, {"_least": run("min", entry)}, ["symbol", "seq", "bars", "_p", "need", "_ok"])
    back = F.col("bars") - 1 - F.col("seq")
    turned = low.withColumns({"_at": F.col("seq").cast("double"), "seq": back.cast("long"), "chunk": F.floor(back / laid.rows).cast("long")})
    turned = Laid(settle(turned, "turned"), laid.rows)
    choice = folds.chunk_fold(turned, _optimal_step, [], ["_p", "need", "_ok", "_at", "_least"], ["exit_seq"], ["symbol", "_at"], warm, max_rounds=max_rounds)
    choice = settle(choice.select("symbol", F.col("_at").cast("long").alias("seq"), "exit_seq"), "choice")
    cand = base.df.join(choice, ["symbol", "seq"])
    kept = folds.non_overlapping(Laid(settle(cand, "cand"), laid.rows), ["symbol", "seq", "ts", "close", "exit_seq"])
    trades = kept.filter("kept = 1")
    exits = base.df.select("symbol", F.col("seq").cast("double").alias("exit_seq"), F.col("_p").alias("exit_p"))
    return trades.join(exits, ["symbol", "exit_seq"]).select(
        "symbol", F.lit(side).alias("side"), F.col("seq").alias("entry_seq"), F.col("exit_seq").cast("long").alias("exit_seq"),
        (F.col("exit_p") - F.col("close") * sign).alias("profit"))


def close_marks(bars: DataFrame, trades: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Entry and close flags on the bars (``symbol, seq``) from long and short trades.

    A trade closes on the bar before the next entry when that lies after its own
    entry, else on its own exit; the last trade closes on its exit.
    """
    order = F.col("entry_seq") * 2 + F.when(F.col("side") == "long", 0).otherwise(1)
    t = trades.withColumn("ts", F.timestamp_seconds(order))
    laid = lay_out(t, chunk_rows, unit="day")
    nxt = add_features(laid, {"next_entry": lead(ncol("entry_seq"))}, ["symbol", "side", "entry_seq", "exit_seq"])
    before = F.col("next_entry") - 1
    close = F.when(before > F.col("entry_seq"), before).otherwise(F.col("exit_seq")).cast("long")
    flags = nxt.select(
        "symbol",
        F.explode(F.array(
            F.struct(F.col("entry_seq").cast("long").alias("seq"), (F.col("side") == "long").cast("int").alias("l"),
                     (F.col("side") == "short").cast("int").alias("s"), F.lit(0).alias("c")),
            F.struct(close.alias("seq"), F.lit(0).alias("l"), F.lit(0).alias("s"), F.lit(1).alias("c")),
        )).alias("m"),
    ).groupBy("symbol", "m.seq").agg(F.max("m.l").alias("l"), F.max("m.s").alias("s"), F.max("m.c").alias("c"))
    z = lambda c, n: F.coalesce(F.col(c), F.lit(0)).alias(n)
    return bars.join(flags, ["symbol", "seq"], "left").select(
        *[f"{c}" for c in bars.columns], z("l", "long_signal"), z("s", "short_signal"), z("c", "close_position"))


def profit_targets(side: str = "long", window: int = 14, stop: float = 0.01) -> dict:
    """Is a trade entered on the next close profitable after ``window`` bars with its
    stop untouched on the bars in between?  (The caller masks by the signal.)"""
    entry, exit_ = lead(C), lead(C, window)
    if side == "long":
        held = roll("min", L, window - 1, None, window - 1) >= entry * (1.0 - stop)
        won = exit_ > entry
    else:
        held = roll("max", H, window - 1, None, window - 1) <= entry * (1.0 + stop)
        won = exit_ < entry
    from tidebars.functions.expr import true

    return {f"{side}_profitable": when(true(held & won), 1, otherwise=0)}


def direction_targets(periods=(1, 3, 5, 10, 14), flat: float = 0.0005) -> dict:
    out = {}
    from tidebars.functions.expr import true

    for k in periods:
        r = lead(C, k) / C - 1.0
        out[f"direction_{k}"] = when(true(r > 0.0), 1, otherwise=0)
        out[f"direction_3class_{k}"] = when(true(r > flat), 2, true(r < -flat), 0, otherwise=1)
        out[f"returns_{k}"] = r
    return out


def regression_targets(k: int = 14) -> dict:
    ahead = lead(C, k)
    return {"close_ahead": ahead, "change_ahead": ahead - C, "side_ahead": signx(ahead - C)}


def next_bar_target(signal_column: str) -> dict:
    from tidebars.functions.expr import coalesce

    return {"target": coalesce(lead(ncol(signal_column)), 0)}
