"""As-of join by symbol: the latest reference row of the same symbol at or before each bar.

Bars and reference rows of a symbol are cut into slices of time.  Both meet in one
exchange by (symbol, slice), where a running last value over the slice finds the
reference; what a slice inherits comes from the last reference row of the slices before,
one row for each slice.  The width of a slice is the largest at which none is too full,
so a busy day is several slices and a quiet year may be one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.plans.layout import settle

#: Widths of a slice in seconds, each a multiple of the next, and the rows that one should not exceed.
WIDTHS = (86_400 * 360, 86_400 * 30, 86_400, 3_600, 600, 60, 1)
MOST_ROWS = 200_000


def _slice(ts: Column, width: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (width * 1_000_000)).cast("bigint")


def slice_width(rows: DataFrame, most: int = MOST_ROWS) -> int:
    """The widest slice that holds at most ``most`` rows(symbol, ts) of every symbol; the narrowest, if none does."""
    day = WIDTHS.index(86_400)
    per_day = settle(rows.groupBy("symbol", _slice(F.col("ts"), WIDTHS[day]).alias("s")).agg(F.count(F.lit(1)).alias("n")), "histogram")
    for i, width in enumerate(WIDTHS):
        if i <= day:
            full = per_day.groupBy("symbol", F.floor(F.col("s") * WIDTHS[day] / width)).agg(F.sum("n").alias("n"))
        else:
            full = rows.groupBy("symbol", _slice(F.col("ts"), width)).agg(F.count(F.lit(1)).alias("n"))
        if (full.agg(F.max("n")).first()[0] or 0) <= most:
            return width
    return WIDTHS[-1]


def asof_by_symbol(bars: DataFrame, ref: DataFrame, values: list[str], order: tuple[str, ...] = (), width: int | None = None, most: int = MOST_ROWS) -> DataFrame:
    """bars with ``values`` and ``ref_ts`` of the latest reference row; null before the first one.

    Of reference rows of one symbol and time the greatest by ``order``, then by the values, counts.  Rows of the
    reference without a time are left out, bars without one get no reference; other columns of ref are ignored."""
    clash = {*values, "ref_ts"} & set(bars.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    ref = ref.filter("ts is not null and symbol is not null").select("symbol", "ts", F.struct(F.col("ts").alias("ref_ts"), *(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), *values).alias("_ref"))
    width = width or slice_width(bars.select("symbol", "ts").unionByName(ref.select("symbol", "ts")), most)
    ref = ref.withColumn("_slice", _slice(F.col("ts"), width))
    sides = bars.select("symbol", "ts", F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(bars.columns))).alias("_bar")).withColumn("_slice", _slice(F.col("ts"), width))
    # What each slice inherits: the greatest reference row of the slices before.
    tops = ref.groupBy("symbol", "_slice").agg(F.max("_ref").alias("_top"))
    slices = sides.select("symbol", "_slice").distinct().join(tops, ["symbol", "_slice"], "full")
    before = Window.partitionBy("symbol").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row for each slice
    inherited = slices.select("symbol", "_slice", F.max("_top").over(before).alias("_old"))
    both = sides.withColumn("_ref", F.lit(None).cast(ref.schema["_ref"].dataType)).unionByName(ref.withColumn("_bar", F.lit(None).cast(sides.schema["_bar"].dataType)))
    # At one time the reference comes first; structs begin with the time, so the greatest so far is the latest.
    so_far = Window.partitionBy("symbol", "_slice").orderBy("ts", F.col("_bar").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_new", F.max("_ref").over(so_far)).filter("_bar is not null and ts is not null")
    found = found.join(inherited, ["symbol", "_slice"], "left").withColumn("_hit", F.coalesce("_new", "_old"))
    bare = sides.filter("ts is null or symbol is null")
    names = [F.col("_bar").getField(f"c{i}").alias(c) for i, c in enumerate(bars.columns)]
    known = found.filter("symbol is not null").select(*names, *[F.col("_hit").getField(v).alias(v) for v in ("ref_ts", *values)])
    none = bare.select(*names, *[F.lit(None).cast(known.schema[v].dataType).alias(v) for v in ("ref_ts", *values)])
    return known.unionByName(none)
