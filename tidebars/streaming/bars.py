"""Streaming bars, incremental indicators over a rolling context, and scoring with cool-down.

Everything is decided by event time, so a stream gives what the whole table gives, in
whatever order its rows arrive within the watermark.  A source that falls silent leaves
its last windows open; a mark, a row without a price whose time lies at the close, moves
the watermark on and has them emitted from state.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidebars.plans.layout import forget, scratch_dir

#: The time of the mark that closes an input (within the reach of pandas).
LAST = "2200-01-01"
#: The symbol of marks.
MARK = "\x00"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_bars(ticks: DataFrame, symbol: Column, price: Column, volume: Column, order: list, width: str = "1 minute", late: str = "1 minute",
                event_time: str = "ts", unique: list[str] | None = None) -> DataFrame:
    """Ticks to bars by event time.

    Repeated ticks (same ``unique`` columns) within the watermark count once;
    ticks later than ``late`` are dropped and show up in the query's
    ``numRowsDroppedByWatermark``.  Ticks without a price are marks.
    """
    t = ticks.withWatermark(event_time, late)
    if unique:
        t = t.dropDuplicatesWithinWatermark(unique)
    t = t.select(F.col(event_time), F.when(price.isNull(), F.lit(MARK)).otherwise(symbol).alias("symbol"), price.alias("_p"), volume.alias("_v"), F.struct(*order).alias("_k"))
    g = t.groupBy("symbol", F.window(event_time, width).alias("w")).agg(
        F.min_by("_p", "_k").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_k").alias("close"),
        F.sum("_v").cast("double").alias("volume"))
    return g.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume").filter(F.col("symbol") != MARK)


# --- indicators over a rolling context --------------------------------------------------------
PRICES = ["open", "high", "low", "close", "volume"]
OUTPUT = "symbol string, ts timestamp, " + ", ".join(f"{c} double" for c in PRICES) + ", sma double, ema_fast double, ema_slow double, rsi double, atr double, obv double, vwap double, top double, bottom double, signal int, repeats long"
_BAR = "ts long, " + ", ".join(f"{c} double" for c in PRICES)
_RUN = "seen long, ema_fast double, ema_slow double, gain double, loss double, atr double, obv double, last_signal long, repeats long, timer long"
_START = (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -1, 0, -1)


class RollingContext(StatefulProcessor):
    """Bars of one symbol in event-time order: those the watermark has not passed, the last n, and the running values.

    A bar waits in a map by its time until the watermark passes it, so bars may come in any order; a time that is held
    already is a repeat and only counted.  One timer stands at the earliest bar that waits."""

    def __init__(self, n: int, fast: int, slow: int, span: int, gap: int):
        self.n, self.fast, self.slow, self.span, self.gap = n, fast, slow, span, gap

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long", ", ".join(f"{c} double" for c in PRICES))
        self.context = handle.getListState("context", _BAR)
        self.run = handle.getValueState("run", _RUN)

    def _running(self) -> list:
        return list(self.run.get()) if self.run.exists() else list(_START)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self._running()
        first = state[9]
        for frame in rows:
            frame = frame[frame["close"].notna()]
            for ts, *bar in zip(frame["ts"].astype("datetime64[ms]").astype("int64"), *(frame[c] for c in PRICES)):
                if self.waiting.containsKey((ts,)):
                    state[8] += 1
                    continue
                self.waiting.updateValue((ts,), tuple(map(float, bar)))
                first = ts if first < 0 else min(first, ts)
        if first >= 0:
            self._wait(state, first)
            self.run.update(tuple(state))
        return iter(())

    def _wait(self, state: list, ts: int) -> None:
        if state[9] == ts:
            return
        if state[9] >= 0:
            self.handle.deleteTimer(state[9])
        self.handle.registerTimer(ts)
        state[9] = ts

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted((k[0], tuple(v)) for k, v in self.waiting.iterator())
        final = [(ts, *bar) for ts, bar in held if ts <= mark]
        state, context = self._running(), [tuple(r) for r in self.context.get()]
        out = []
        for bar in final:
            self.waiting.removeKey((bar[0],))
            if context and bar[0] <= context[-1][0]:  # final once; a row of the same time is a repeat
                state[8] += 1
                continue
            context = [*context[-(self.n - 1) :], bar] if self.n > 1 else [bar]
            out.append((key[0], *self._advance(state, context)))
        state[9] = -1
        if len(final) < len(held):
            self._wait(state, held[len(final)][0])
        self.run.update(tuple(state))
        if out:
            self.context.put(context)
            frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUTPUT.split(", ")])
            yield frame.assign(ts=pd.to_datetime(frame["ts"], unit="ms"))

    def _advance(self, state: list, context: list[tuple]) -> tuple:
        """Update the running values by the last bar of the context; the bar and its indicators."""
        ts, open_, high, low, close, volume = context[-1]
        seen = state[0]
        if seen == 0:
            state[1] = state[2] = close
            state[5] = high - low
        else:
            before = context[-2][4] if len(context) > 1 else state[1]
            d = close - before
            state[1] += (close - state[1]) * 2 / (self.fast + 1)
            state[2] += (close - state[2]) * 2 / (self.slow + 1)
            state[3] += (max(d, 0.0) - state[3]) / self.span
            state[4] += (max(-d, 0.0) - state[4]) / self.span
            state[5] += (max(high, before) - min(low, before) - state[5]) / self.span
            state[6] += volume if d > 0 else -volume if d < 0 else 0.0
        full = len(context) == self.n
        sma = sum(b[4] for b in context) / self.n if full else None
        traded = sum(b[5] for b in context)
        vwap = sum((b[2] + b[3] + b[4]) / 3 * b[5] for b in context) / traded if full and traded else None
        rsi = None if seen < self.span - 1 else 100.0 if state[4] == 0 else 100 - 100 / (1 + state[3] / state[4])
        hit = sma is not None and close > sma and (state[7] < 0 or seen - state[7] >= self.gap)
        if hit:
            state[7] = seen
        state[0] = seen + 1
        edges = (max(b[2] for b in context), min(b[3] for b in context)) if full else (None, None)
        return (*context[-1], sma, state[1], state[2], rsi, state[5], state[6], vwap, *edges, int(hit), state[8])

    def close(self) -> None:
        pass


def stream_indicators(bars: DataFrame, late: str = "1 hour", n: int = 20, fast: int = 12, slow: int = 26, span: int = 14, gap: int = 10) -> DataFrame:
    """Indicators and cooled-down signals of a stream of bars (symbol, ts, open, high, low, close, volume).

    A bar is given out when the watermark has passed it; bars over ``late`` behind are dropped and show up in the query's
    ``numRowsDroppedByWatermark``, repeats are counted.  State per symbol: n bars, those within ``late``, ten numbers.
    Start the query inside ``state_in_rocksdb``."""
    if n < 2:
        raise ValueError("the context holds two bars at least")
    known = bars.select(F.when(F.col("close").isNull(), F.lit(MARK)).otherwise(F.col("symbol")).alias("symbol"), "ts", *PRICES).withWatermark("ts", late)
    return known.groupBy("symbol").transformWithStateInPandas(RollingContext(n, fast, slow, span, gap), OUTPUT, "Append", "EventTime")


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that maps and timers need, for queries started inside."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


# --- bounded runs ---------------------------------------------------------------------------------
def shared_root(spark: SparkSession, label: str) -> str:
    """A new folder that all executors see; deleted when the driver ends."""
    root = f"{scratch_dir(spark)}/tidebars/{label}-{uuid.uuid4().hex}"
    forget(spark, root)
    return root


def replayed(df: DataFrame, unit: str, label: str, files: int = 1) -> DataFrame:
    """df as a stream of bounded batches: files cut by time (calendar unit), in the order of time, ``files`` a batch."""
    spark, root = df.sparkSession, shared_root(df.sparkSession, label)
    cut = F.date_trunc(unit, "ts")
    units = [r.u for r in df.select(cut.alias("u")).distinct().orderBy("u").collect()]  # calendar units
    for i, u in enumerate(units):
        df.filter(cut == F.lit(u)).write.parquet(f"{root}/{i:08d}")
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(root)


def drained(spark: SparkSession, stream: DataFrame, build, label: str) -> DataFrame:
    """Run ``build(stream)`` to the end of its input, then mark the close, so that open windows come out of its state."""
    root = shared_root(spark, label)
    marks = spark.createDataFrame([], stream.schema)
    marks.write.parquet(f"{root}/marks")
    closing = spark.readStream.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{root}/marks")

    def run() -> None:
        out = build(stream.unionByName(closing))
        q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append")
        q.trigger(availableNow=True).start().awaitTermination()

    run()
    close = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else F.lit(LAST).cast(f.dataType).alias("ts") for f in stream.schema])
    close.write.mode("append").parquet(f"{root}/marks")
    run()
    return spark.read.schema(build(stream).schema).parquet(f"{root}/out")


def score_stream(bars: DataFrame, model, sink, every: str = "5 seconds", checkpoint: str | None = None):
    """Score each micro-batch with a fitted pipeline and hand it to ``sink(df, batch_id)``."""

    def batch(df, batch_id):
        sink(model.transform(df), batch_id)

    w = bars.writeStream.foreachBatch(batch).trigger(processingTime=every)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    return w.start()
