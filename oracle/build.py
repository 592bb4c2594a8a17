"""Pairs a feature query on Spark with its plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from oracle.sqltext import feature_sql
from oracle.tables import BARS, TS
from tidebars.plans.features import add_features
from tidebars.plans.shelf import shelf

STAMP = "yyyy-MM-dd HH:mm:ss"


def cut(x, digits=4):
    """Decimals are cut at a threshold off the decimal grid, so that engine
    round-off in the last bits cannot change the result."""
    s = float(10**digits)
    return (F.floor(x * F.lit(s) + F.lit(0.4871)) / F.lit(s)).cast("double")


def cut_sql(text, digits=4):
    s = f"{float(10 ** digits)}::DOUBLE"
    return f"(floor(({text}) * {s} + 0.4871::DOUBLE) / {s})"


def numbers(table, features, digits=4, chunk_rows=None):
    digit = lambda n: digits.get(n, 4) if isinstance(digits, dict) else digits

    def run(spark, sf):
        df = add_features(shelf(spark, sf, table, chunk_rows), features, ["symbol", "ts"])
        return df.select("symbol", F.date_format("ts", STAMP).alias("ts"), *[cut(F.col(n), digit(n)).alias(n) for n in features])

    sql = feature_sql(BARS[table], features, {"symbol": "symbol", "ts": TS, **{n: cut_sql("{x}", digit(n)) for n in features}})
    return run, sql


def signals(table, features, chunk_rows=None):
    def run(spark, sf):
        df = add_features(shelf(spark, sf, table, chunk_rows), features, ["symbol", "ts"])
        return df.select("symbol", F.date_format("ts", STAMP).alias("ts"), *[F.col(n).cast("int").alias(n) for n in features])

    sql = feature_sql(BARS[table], features, {"symbol": "symbol", "ts": TS, **{n: "CAST({x} AS INTEGER)" for n in features}})
    return run, sql
