"""Trade ledgers from signals, without a bar-by-bar loop.

Closing resets the position whatever it was, so the bars between two close
marks are independent: each such segment holds at most one trade, opened by
its first entry signal.  Numbering segments is a running count; the rest is
one aggregation per segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.functions.expr import C, Expr, SEQ, coalesce, lag, ncol, run, true, when
from tidebars.plans.features import add_features
from tidebars.plans.layout import Laid, lay_out, settle


def _segment_trades(rows: DataFrame, factor: float) -> DataFrame:
    """rows: symbol, seq, ts, close, segment, side (0 when the bar opens nothing)."""
    bar = F.struct("seq", "ts", "close", "side")
    seg = rows.groupBy("symbol", "segment").agg(
        F.min(F.when(F.col("side") != 0, bar)).alias("entry"), F.min(bar).alias("first"))
    seg = settle(seg, "segments")
    ends = seg.select("symbol", (F.col("segment") - 1).alias("segment"), F.col("first").alias("exit"))
    t = seg.filter("entry is not null").join(ends, ["symbol", "segment"], "left")
    side = F.col("entry.side")
    return t.select(
        "symbol", F.when(side > 0, "long").otherwise("short").alias("side"),
        F.col("entry.seq").alias("entry_seq"), F.col("entry.ts").alias("entry_ts"), F.col("entry.close").alias("entry_px"),
        F.col("exit.seq").alias("exit_seq"), F.col("exit.ts").alias("exit_ts"), F.col("exit.close").alias("exit_px"),
        ((F.col("exit.close") - F.col("entry.close")) * side * factor).alias("pnl"),
    )


def signal_ledger(laid: Laid, long_: Expr, short: Expr, close: Expr, factor: float = 1000.0) -> DataFrame:
    """Close first, then open when flat, long before short."""
    side = when(true(long_), 1, true(short), -1, otherwise=0)
    feats = {"segment": run("sum", when(true(close), 1, otherwise=0)), "side": side}
    rows = add_features(laid, feats, ["symbol", "seq", "ts", "close"])
    return _segment_trades(rows, factor)


def reversal_ledger(laid: Laid, signal: Expr, factor: float = 1.0) -> DataFrame:
    """An opposite signal closes the position and opens the other side."""
    held = coalesce(run("last", when(signal.ne(0), signal)), 0)
    turn = true(held.ne(lag(held))) | SEQ.eq(0)
    feats = {"segment": run("sum", when(turn, 1, otherwise=0)), "side": when(turn, held, otherwise=0)}
    rows = add_features(laid, feats, ["symbol", "seq", "ts", "close"])
    return _segment_trades(rows, factor)


def balance(trades: DataFrame, start: float = 0.0, chunk_rows: int | None = None) -> DataFrame:
    """Running balance per symbol in exit order (closed trades only)."""
    done = trades.filter("exit_ts is not null").withColumn("ts", F.col("exit_ts"))
    laid = lay_out(done, chunk_rows)
    laid = Laid(settle(laid.df, "closed"), laid.rows)
    return add_features(laid, {"balance": run("sum", ncol("pnl")) + start}, ["symbol", "side", "entry_ts", "exit_ts", "pnl"])


def trade_log(trades: DataFrame) -> DataFrame:
    """One row per action (Buy / Sell / Close) with its price."""
    act = F.array(
        F.struct(F.col("entry_ts").alias("ts"), F.when(F.col("side") == "long", "Buy").otherwise("Sell").alias("action"), F.col("entry_px").alias("price")),
        F.struct(F.col("exit_ts").alias("ts"), F.lit("Close").alias("action"), F.col("exit_px").alias("price")),
    )
    return trades.select("symbol", F.explode(act).alias("a")).select("symbol", "a.*").filter("ts is not null")


def trade_summary(trades: DataFrame) -> DataFrame:
    done = trades.filter("exit_ts is not null")
    return done.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("trades"), F.sum((F.col("pnl") > 0).cast("int")).cast("long").alias("wins"),
        F.sum("pnl").alias("pnl"), F.max("pnl").alias("best"), F.min("pnl").alias("worst"),
    )
