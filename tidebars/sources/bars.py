"""Bar tables: schema, readers, tick-to-bar aggregation, resampling, writers."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("ts", T.TimestampType(), False),
        *[T.StructField(c, T.DoubleType(), True) for c in ("open", "high", "low", "close", "volume")],
    ]
)
RAW_SCHEMA = T.StructType(
    [T.StructField("Date", T.IntegerType()), T.StructField("Time", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("Open", "High", "Low", "Close", "Volume")]
)
PRICE_COLUMNS = ("open", "high", "low", "close", "volume")


def read_raw_bars(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Headerless CSV files of Date, Time, Open, High, Low, Close, Volume."""
    raw = spark.read.schema(RAW_SCHEMA).csv(path, header=False, mode="FAILFAST")
    return timed_bars(raw, symbol)


def timed_bars(raw: DataFrame, symbol: str) -> DataFrame:
    ts = F.to_timestamp(F.concat_ws(" ", F.col("Date").cast("string"), "Time"), "yyyyMMdd HH:mm:ss")
    return raw.select(
        F.lit(symbol).alias("symbol"), ts.alias("ts"), *[F.col(c.capitalize()).cast("double").alias(c) for c in PRICE_COLUMNS]
    )


def normalise_columns(df: DataFrame) -> DataFrame:
    """Map any column whose name contains open / high / low / close / volume."""
    picked = {}
    for want in PRICE_COLUMNS:
        hits = [c for c in df.columns if want in c.lower()]
        exact = [c for c in hits if c.lower() == want]
        if not hits:
            raise ValueError(f"no column for {want!r} among {df.columns}")
        picked[want] = (exact or hits)[0]
    rest = [c for c in df.columns if c not in picked.values()]
    return df.select(*rest, *[F.col(f"`{src}`").cast("double").alias(dst) for dst, src in picked.items()])


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def ticks_to_bars(ticks: DataFrame, symbol: Column, bucket: Column, price: Column, volume: Column, order: list) -> DataFrame:
    """One bar per (symbol, bucket); map-side partial aggregation, one shuffle.

    ``order`` must be unique inside a bucket, so first and last are defined.
    """
    key = F.struct(*order)
    return (
        ticks.select(symbol.alias("symbol"), bucket.alias("ts"), price.alias("_p"), volume.alias("_v"), key.alias("_k"))
        .groupBy("symbol", "ts")
        .agg(
            F.min_by("_p", "_k").alias("open"),
            F.max("_p").alias("high"),
            F.min("_p").alias("low"),
            F.max_by("_p", "_k").alias("close"),
            F.sum("_v").cast("double").alias("volume"),
        )
    )


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Bars of a coarser calendar unit; open and close by time order."""
    return (
        bars.groupBy("symbol", F.date_trunc(unit, "ts").alias("ts"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
    )


def resample_last(bars: DataFrame, unit: str) -> DataFrame:
    """Last bar of each calendar unit, under its own time."""
    last = F.max_by(F.struct("ts", *PRICE_COLUMNS), "ts").alias("b")
    return bars.groupBy("symbol", F.date_trunc(unit, "ts").alias("period")).agg(last).select("symbol", "period", "b.*")


def tail_bars(bars: DataFrame, n: int) -> DataFrame:
    """Last ``n`` bars of each symbol without ordering a whole symbol in one task:
    a per-unit row count finds the unit in which the n-th last bar lies."""
    b = bars.withColumn("_u", F.date_trunc("month", "ts"))
    per = b.groupBy("symbol", "_u").agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy("symbol").orderBy(F.col("_u").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("symbol", "_u", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_after")).filter(F.col("_after") < n)
    inside = Window.partitionBy("symbol", "_u").orderBy(F.col("ts").desc())
    kept = b.join(per, ["symbol", "_u"]).withColumn("_r", F.row_number().over(inside) + F.col("_after"))
    return kept.filter(F.col("_r") <= n).drop("_u", "_after", "_r")


def gap_report(bars: DataFrame, unit: str = "day") -> DataFrame:
    """Per symbol: bars, span in units and missing units (counts only, no series)."""
    span = F.datediff(F.max("ts"), F.min("ts")) + 1 if unit == "day" else (
        (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 3600 + 1
    )
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), span.cast("long").alias("span")
    ).withColumn("missing", F.col("span") - F.col("bars"))


def select_features(df: DataFrame, essential: list[str], features: list[str]) -> DataFrame:
    """Essential columns, then the listed features in order, without repeats."""
    return df.select(*dict.fromkeys([*essential, *[f for f in features if f in df.columns]]))


def align_features(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Fixed feature order; missing ones become 0, extra ones are dropped."""
    cols = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) if f in df.columns else F.lit(0.0).alias(f) for f in features]
    return df.select(*keys, *cols)


def write_bars(bars: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet by symbol and month, so time and symbol filters prune files."""
    bars.withColumn("month", F.date_format("ts", "yyyy-MM")).repartition("symbol", "month").write.mode(mode).partitionBy(
        "symbol", "month"
    ).parquet(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("month")


def read_feature_list(spark: SparkSession, path: str) -> DataFrame:
    """Names of a text file, one per line, blanks and repeats dropped, order kept."""
    lines = spark.read.text(path).select(F.trim("value").alias("feature"), F.monotonically_increasing_id().alias("_i"))
    return lines.filter("feature <> ''").groupBy("feature").agg(F.min("_i").alias("_i")).orderBy("_i").select("feature")


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trial logs (JSON): one row per finished trial with its settings and scores."""
    schema = T.StructType(
        [
            T.StructField("model_type", T.StringType()),
            T.StructField("trial_id", T.StringType()),
            T.StructField("status", T.StringType()),
            T.StructField("val_loss", T.DoubleType()),
            T.StructField("val_accuracy", T.DoubleType()),
            T.StructField("settings", T.MapType(T.StringType(), T.StringType())),
        ]
    )
    t = spark.read.schema(schema).json(path, multiLine=True)
    return t.withColumn("file", F.input_file_name()).filter(F.col("val_loss").isNotNull() & (F.upper("status") == "COMPLETED"))


def best_trials(trials: DataFrame, k: int = 5) -> DataFrame:
    """The k lowest losses per model (rank over a pre-cut, bounded candidate list)."""
    w = Window.partitionBy("model_type").orderBy("val_loss", "trial_id")
    return trials.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def shared_settings(best: DataFrame) -> DataFrame:
    """Most frequent value of each setting among the best trials."""
    flat = best.select("model_type", F.explode("settings").alias("setting", "value"))
    n = flat.groupBy("model_type", "setting", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("model_type", "setting").agg(
        F.max_by("value", F.struct("n", "value")).alias("value"), F.max("n").alias("n")
    )


# --- adapters for the driver's tables ------------------------------------------
def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lineitem_bars(spark, sf, symbol):
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    return ticks_to_bars(
        _table(spark, sf, "lineitem"), symbol, F.date_trunc("day", "l_shipdate").cast("timestamp"), price, F.col("l_quantity"), order
    )


def _event_bars(spark, sf, symbol, unit):
    ticks = _table(spark, sf, "events")
    return ticks_to_bars(
        ticks, symbol, F.date_trunc(unit, "ts").cast("timestamp"), F.col("value"), F.lit(1.0), ["ts", "event_id"]
    )


ADAPTERS = {
    "events_hourly": lambda s, d: _event_bars(s, d, F.col("event_type"), "hour"),
    "events_user_daily": lambda s, d: _event_bars(s, d, F.col("user_id").cast("string"), "day"),
    "part_daily": lambda s, d: _lineitem_bars(s, d, F.col("l_suppkey").cast("string")),
    "flag_daily": lambda s, d: _lineitem_bars(s, d, F.col("l_returnflag")),
    "combo_daily": lambda s, d: _lineitem_bars(s, d, F.concat("l_returnflag", "l_linestatus")),
    "market_daily": lambda s, d: _lineitem_bars(s, d, F.lit("ALL")),
    "orders_daily": lambda s, d: ticks_to_bars(
        _table(s, d, "orders"), F.col("o_orderpriority"), F.date_trunc("day", "o_orderdate").cast("timestamp"),
        F.col("o_totalprice"), F.lit(1.0), ["o_orderkey"],
    ),
}


PANEL_SIZE = 6


def _panel(spark, sf):
    """The first six symbols by name side by side, as many as the rules on several assets name."""
    from tidebars.operators.cross_asset import panel

    bars = ADAPTERS["combo_daily"](spark, sf)
    names = [r.symbol for r in bars.select("symbol").distinct().orderBy("symbol").limit(PANEL_SIZE).collect()]
    return panel(bars, names)


def macro_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly reference series of the orders table; a month counts from its end on."""
    o = _table(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp").alias("m")).agg(
        F.avg("o_totalprice").alias("p"), F.count(F.lit(1)).cast("double").alias("n"),
        F.avg(F.when(F.col("o_orderpriority").substr(1, 1).isin("1", "2"), 100.0).otherwise(0.0)).alias("bullish"),
        F.avg(F.when(F.col("o_orderpriority").substr(1, 1).isin("4", "5"), 100.0).otherwise(0.0)).alias("bearish"),
    )
    w = Window.orderBy("m")  # one row per month
    return o.select(
        F.add_months("m", 1).cast("timestamp").alias("ts"), "bullish", "bearish",
        (F.col("p") / 5000.0).alias("pmi"), F.col("n").alias("confidence"),
        F.avg("n").over(w.rowsBetween(-2, 0)).alias("confidence_mean3"), (F.col("n") / 4.0).alias("exposure"),
        (F.col("p") / 150000.0).alias("rate"), (F.coalesce(F.lag("p").over(w), F.col("p")) / 150000.0).alias("rate_prev"),
        (F.col("p") / 50000.0).alias("risk"), (F.col("p") / 80000.0).alias("inflation"),
        ((F.col("bullish") - F.col("bearish")) / 10.0).alias("sentiment"),
    )


MACRO_COLUMNS = ["bullish", "bearish", "pmi", "confidence", "confidence_mean3", "exposure", "rate", "rate_prev", "risk", "inflation", "sentiment"]


def _macro_bars(spark, sf):
    from tidebars.operators.cross_asset import asof_join

    bars = ADAPTERS["flag_daily"](spark, sf)
    return asof_join(bars, macro_monthly(spark, sf), MACRO_COLUMNS)


ADAPTERS["panel_daily"] = _panel
ADAPTERS["macro_daily"] = _macro_bars


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ADAPTERS[name](spark, sf_dir)
