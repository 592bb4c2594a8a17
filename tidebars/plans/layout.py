"""Chunk layout: the way one long symbol is spread over many tasks.

Every bar gets ``seq`` (its position in the symbol) and ``chunk`` (``seq``
divided by a fixed number of rows).  Positions come from a histogram of rows
per (symbol, calendar unit), so no task ever sorts a whole symbol: the only
per-symbol step runs over the histogram.  Work on ordered frames is then
partitioned by (symbol, chunk); a chunk receives copies of the last bars of
the chunks before it (the halo), which makes every finite frame exact.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_CONF = "spark.tidebars.chunkRows"
DEFAULT_CHUNK_ROWS = 65536


def chunk_rows_of(spark: SparkSession, rows: int | None = None) -> int:
    return int(rows or spark.conf.get(CHUNK_CONF, str(DEFAULT_CHUNK_ROWS)))


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's checkpoint folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="tidebars-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def forget(spark: SparkSession, path: str) -> None:
    """Have an intermediate table deleted when the session's driver ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def settle(df: DataFrame, label: str = "t", by: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives executor
    loss, and later scans prune columns."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tidebars/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    forget(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Laid:
    """Bars with ``seq`` and ``chunk``, and the chunk size they were cut with.

    ``gaps``: prices or volumes may be null, so frames count their values
    instead of trusting positions."""

    df: DataFrame
    rows: int
    gaps: bool = True


def lay_out(bars: DataFrame, chunk_rows: int | None = None, unit: str = "month") -> Laid:
    """Number the bars of each symbol and cut them into chunks.

    ``unit`` is the calendar unit of the histogram; pick one that holds at most
    a few hundred thousand bars (``month`` for daily or hourly bars, ``day`` for
    one-minute or one-second bars).
    """
    rows = chunk_rows_of(bars.sparkSession, chunk_rows)
    # NaN is a missing value everywhere, so that no comparison with it holds.
    numbers = [f.name for f in bars.schema.fields if f.dataType.typeName() in ("double", "float")]
    bars = bars.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numbers})
    b = bars.withColumn("_unit", F.date_trunc(unit, "ts"))
    per_unit = b.groupBy("symbol", "_unit").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("symbol").orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_unit.select(
        "symbol", "_unit", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy("symbol")).alias("bars"),
    )
    inside = Window.partitionBy("symbol", "_unit").orderBy("ts")
    numbered = (
        b.join(starts, ["symbol", "_unit"])
        .withColumn("seq", (F.col("_start") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_unit", "_start")
    )
    return Laid(numbered.withColumn("chunk", F.floor(F.col("seq") / rows).cast("long")), rows)


def with_halo(laid: Laid, back: int, fwd: int = 0) -> DataFrame:
    """Copy each bar to the chunks whose frames reach it.

    A bar at ``seq`` is needed by bars ``seq - fwd .. seq + back``; ``bars``, the
    length of the symbol, keeps copies from going past its last chunk.
    """
    if not back and not fwd:
        return laid.df.repartition("symbol", "chunk")
    b = F.lit(laid.rows)
    lo = F.floor(F.greatest(F.col("seq") - fwd, F.lit(0)) / b).cast("long")
    hi = F.floor(F.least(F.col("seq") + back, F.col("bars") - 1) / b).cast("long")
    if back == 0:
        hi = F.col("chunk")
    if fwd == 0:
        lo = F.col("chunk")
    return laid.df.withColumn("chunk", F.explode(F.sequence(lo, hi))).repartition("symbol", "chunk")


def own_rows(df: DataFrame, rows: int) -> DataFrame:
    """Drop the halo copies."""
    return df.filter(F.floor(F.col("seq") / rows) == F.col("chunk"))
