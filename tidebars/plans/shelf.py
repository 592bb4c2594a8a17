"""Bar tables laid out once per session and folder, then read by every query."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidebars.plans.layout import Laid, chunk_rows_of, lay_out, settle
from tidebars.sources.bars import adapter

_SHELF: dict[tuple, Laid] = {}


def shelf(spark: SparkSession, sf_dir: str, name: str, chunk_rows: int | None = None) -> Laid:
    rows = chunk_rows_of(spark, chunk_rows)
    key = (spark.sparkContext.applicationId, str(sf_dir), name, rows)
    if key not in _SHELF:
        laid = lay_out(adapter(spark, sf_dir, name), rows)
        df = settle(laid.df, name)
        numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
        _SHELF[key] = Laid(df, rows, any(df.agg(*[F.count_if(F.col(c).isNull()) for c in numbers]).first() or ()))
    return _SHELF[key]
