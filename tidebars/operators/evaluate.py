"""Scores of predictions: direction, error, calibration, votes, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.expr import absx, lag, ncol, signx, true, when
from tidebars.plans.features import add_features
from tidebars.plans.layout import Laid

# fixed values: score thresholds per model and side
THRESHOLDS = [
    ("LSTM", "buy", 0.6), ("GRU", "buy", 0.433), ("Conv1D", "buy", 0.5), ("Conv1D_LSTM", "buy", 0.5),
    ("LSTM", "sell", 0.4), ("GRU", "sell", 0.4), ("Conv1D", "sell", 0.6), ("Conv1D_LSTM", "sell", 0.4),
]


def calibrate(p: Column) -> Column:
    """Logistic of 2p - 1."""
    return 1.0 / (1.0 + F.exp(-(2.0 * p - 1.0)))


def direction_accuracy(laid: Laid, actual: str, predicted: str) -> DataFrame:
    """Share of bars on which actual and predicted change have the same sign."""
    a, p = ncol(actual), ncol(predicted)
    hit = when(signx(a - lag(a)).eq(signx(p - lag(p))), 1.0, signx(a - lag(a)).ne(signx(p - lag(p))), 0.0)
    return add_features(laid, {"hit": hit}, ["symbol"]).groupBy("symbol").agg(F.avg("hit").alias("direction_accuracy"))


def direction_aware_loss(laid: Laid, actual: str, predicted: str, direction=0.3, magnitude=0.7) -> DataFrame:
    acc = direction_accuracy(laid, actual, predicted)
    e = laid.df.groupBy("symbol").agg(F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("_mae"), F.stddev_pop(actual).alias("_sd"))
    loss = direction * (1 - F.col("direction_accuracy")) + magnitude * F.tanh(F.try_divide(F.col("_mae"), F.col("_sd")))
    return acc.join(e, "symbol").select("symbol", loss.alias("loss"))


def asymmetric_loss(df: DataFrame, actual: str, predicted: str, beta: float = 1.0) -> DataFrame:
    """Squared error, under-forecasts weighted by ``beta``."""
    d = F.col(actual) - F.col(predicted)
    return df.agg(F.avg(F.when(d > 0, beta * d * d).otherwise(d * d)).alias("loss"))


def forecast_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """RMSE, MAE and R2 for each step of two equally long arrays, and overall (step -1)."""
    s = df.select(F.posexplode(F.arrays_zip(F.col(actual).alias("a"), F.col(predicted).alias("p"))).alias("step", "x"))
    s = s.select(F.explode(F.array("step", F.lit(-1))).alias("step"), F.col("x.a").cast("double").alias("a"), F.col("x.p").cast("double").alias("p"))
    err = F.col("a") - F.col("p")
    return s.groupBy("step").agg(
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
        (1 - F.try_divide(F.avg(err * err), F.var_pop("a"))).alias("r2"), F.count(F.lit(1)).alias("n"))


def interval_forecast(df: DataFrame, predicted: str, actual: str, z: float = 1.96) -> DataFrame:
    """Prediction with bounds of z times the root mean squared error."""
    err = F.col(actual) - F.col(predicted)
    s = df.agg(F.sqrt(F.avg(err * err)).alias("_rmse"))
    return df.crossJoin(F.broadcast(s)).select(  # one row
        "*", (F.col(predicted) - z * F.col("_rmse")).alias("lower"), (F.col(predicted) + z * F.col("_rmse")).alias("upper")).drop("_rmse")


def threshold_signals(pred: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Predictions (ts, side, model, probability) above their model's threshold."""
    j = pred.join(F.broadcast(thresholds), ["model", "side"])  # one row per model and side
    return j.withColumn("signal", F.col("probability") > F.col("threshold"))


def percentile_thresholds(pred: DataFrame, p: float = 0.95, floor: float = 0.4) -> DataFrame:
    """Threshold per model and side from its own probabilities, never under ``floor``."""
    t = pred.groupBy("model", "side").agg(F.percentile_approx("probability", F.lit(p), 10000).alias("t"))
    return t.select("model", "side", F.greatest("t", F.lit(floor)).alias("threshold"))


def weighted_vote(pred: DataFrame, over: float = 0.4) -> DataFrame:
    """Weighted mean of model probabilities per time and side."""
    v = pred.groupBy("ts", "side").agg(
        F.try_divide(F.sum(F.col("probability") * F.col("weight")), F.sum("weight")).alias("vote"), F.count(F.lit(1)).alias("models"))
    return v.withColumn("signal", F.when(F.col("vote") > over, 1).otherwise(0))


def tiered_rule(df: DataFrame) -> DataFrame:
    """Six cut-offs on class probabilities and forecast returns, AND-ed; weighted confidence."""
    ok = (
        (F.col("buy_probability") > 0.6) & (F.col("sell_probability") < 0.4) & (F.col("direction_probability") > 0.55)
        & (F.col("return_1") > 0.0) & (F.col("return_5") > 0.0) & (F.col("return_14") > 0.0005))
    conf = 0.4 * F.col("buy_probability") + 0.3 * (1 - F.col("sell_probability")) + 0.3 * F.col("direction_probability")
    return df.withColumn("signal", F.when(F.coalesce(ok, F.lit(False)), 1).otherwise(0)).withColumn("confidence", conf)


def model_summary(pred: DataFrame) -> DataFrame:
    return pred.groupBy("model", "side").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("signal").cast("long")).alias("signals"),
        F.avg(F.col("signal").cast("double")).alias("rate"), F.avg("probability").alias("avg_probability"),
        F.min("probability").alias("min_probability"), F.max("probability").alias("max_probability"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    c = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("_all"))
    return c.crossJoin(F.broadcast(t)).select("label", "n", (F.col("n") / F.col("_all")).alias("share"))  # one row


def structure_report(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Rows, columns, nulls, positives: one pass."""
    nulls = sum((F.sum(F.col(c).isNull().cast("long")) for c in features), start=F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(features)).alias("features"), nulls.cast("long").alias("nulls"),
        F.sum((F.col(label) == 1).cast("long")).alias("positives"), F.avg((F.col(label) == 1).cast("double")).alias("rate"))
