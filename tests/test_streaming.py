"""Streams against the whole table: any order within the watermark, repeats, late rows, marks, restarts."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebars.streaming import bars as S

START = dt.datetime(2024, 1, 1)
BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def bar(symbol, hour, close):
    return (symbol, START + dt.timedelta(hours=hour), close - 1.0, close + 2.0, close - 2.0, close, 10.0 + hour % 7)


def walk(seed, n=90):
    return [float(100 + x) for x in np.random.default_rng(seed).normal(size=n).cumsum()]


def plain(rows, n=20, fast=12, slow=26, span=14, gap=10):
    """The same columns, bar by bar over the whole table."""
    out = []
    for symbol in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == symbol), key=lambda r: r[1])
        f = s = g = l = a = o = 0.0
        last = None
        for i, (_, ts, _, high, low, close, volume) in enumerate(mine):
            if i == 0:
                f = s = close
                a = high - low
            else:
                p = mine[i - 1][5]
                f, s = f + (close - f) * 2 / (fast + 1), s + (close - s) * 2 / (slow + 1)
                g, l = g + (max(close - p, 0) - g) / span, l + (max(p - close, 0) - l) / span
                a += (max(high, p) - min(low, p) - a) / span
                o += volume * np.sign(close - p)
            w = mine[i - n + 1 : i + 1] if i >= n - 1 else []
            sma = sum(x[5] for x in w) / n if w else np.nan
            hit = bool(w) and close > sma and (last is None or i - last >= gap)
            last = i if hit else last
            vwap = sum((x[3] + x[4] + x[5]) / 3 * x[6] for x in w) / sum(x[6] for x in w) if w else np.nan
            rsi = np.nan if i < span - 1 else 100.0 if l == 0 else 100 - 100 / (1 + g / l)
            out.append((symbol, ts, sma, f, s, rsi, a, o, vwap, max((x[3] for x in w), default=np.nan), min((x[4] for x in w), default=np.nan), int(hit)))
    return pd.DataFrame(out, columns=["symbol", "ts", "sma", "ema_fast", "ema_slow", "rsi", "atr", "obv", "vwap", "top", "bottom", "signal"])


def same(got, rows):
    want = plain(rows)
    got = got.toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    assert got[["symbol", "signal"]].equals(want[["symbol", "signal"]].astype(got[["symbol", "signal"]].dtypes)) and (got["ts"].to_numpy() == want["ts"].to_numpy()).all()
    for c in want.columns[2:-1]:
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c
    return got


def files(spark, root, parts):
    """A stream of one file a batch, in the order given."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, BARS).coalesce(1).write.parquet(f"{root}/{i:04d}")
    return spark.readStream.schema(spark.createDataFrame([], BARS).schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(root))


def test_any_order_within_the_watermark(spark, tmp_path):
    rows = [bar("A", i, c) for i, c in enumerate(walk(1))] + [bar("B", 2 * i, c) for i, c in enumerate(walk(2, 40))] + [bar("C", 3, 5.0)]
    # Rows move by up to 9 hours; the watermark allows 12.
    rnd = np.random.default_rng(7)
    order = sorted(rows, key=lambda r: (r[1] - START).total_seconds() / 3600 + rnd.uniform(0, 9))
    parts = [order[i : i + 17] for i in range(0, len(order), 17)]
    with S.state_in_rocksdb(spark):
        got = S.drained(spark, files(spark, tmp_path / "in", parts), lambda s: S.stream_indicators(s, "12 hours"), "test")
    same(got, rows)


def test_repeats_are_counted_and_late_rows_dropped(spark, tmp_path):
    rows = [bar("A", i, c) for i, c in enumerate(walk(3, 40))]
    parts = [rows[:20], [rows[19], rows[19], *rows[20:30]], [bar("A", 2, 999.0)], rows[30:]]
    with S.state_in_rocksdb(spark):
        got = S.drained(spark, files(spark, tmp_path / "in", parts), lambda s: S.stream_indicators(s, "2 hours"), "test")
    got = same(got, rows)
    assert got["repeats"].iloc[-1] == 2


def test_a_restarted_stream_goes_on_from_its_state(spark, tmp_path):
    rows = [bar("A", i, c) for i, c in enumerate(walk(4, 60))]

    def run(part, name):
        spark.createDataFrame(part, BARS).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        with S.state_in_rocksdb(spark):
            s = spark.readStream.schema(spark.createDataFrame([], BARS).schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
            q = S.stream_indicators(s, "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
            q.trigger(availableNow=True).start().awaitTermination()

    run(rows[:25], "a")
    before = spark.read.parquet(str(tmp_path / "out")).count()
    run(rows[25:], "b")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert before == 24
    # The last hour is still open.
    same(got, rows[:59])


def test_marks_close_open_windows(spark, tmp_path):
    ticks = [(i, START + dt.timedelta(minutes=7 * i), "X" if i % 3 else "Y", float(i)) for i in range(50)]
    schema = "id long, ts timestamp, sym string, px double"
    spark.createDataFrame(ticks, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    build = lambda s: S.stream_bars(s, F.col("sym"), F.col("px"), F.lit(1.0), ["ts", "id"], "1 hour", "1 hour", "ts", ["id"])
    got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in S.drained(spark, stream, build, "test").collect()}
    want = {}
    for _, ts, sym, px in ticks:
        want.setdefault((sym, ts.replace(minute=0)), []).append(px)
    assert got == {k: (v[0], max(v), min(v), v[-1], float(len(v))) for k, v in want.items()}


def test_a_context_needs_two_bars(spark):
    with pytest.raises(ValueError):
        S.stream_indicators(spark.createDataFrame([], BARS), n=1)


def test_folders_of_streams_are_forgotten(spark, tmp_path):
    assert "/tidebars/x-" in S.shared_root(spark, "x")
