"""Walk-forward backtest: models refitted on all that was known, scored on what came next.

Time is cut into folds of a calendar unit.  A bar's label looks `horizon` bars ahead,
so it is known from the fold after the bar that completes it; a model for a fold is
fitted on all rows known by then.  Models of sums (Gaussian class means, ridge
regression) need no refit: each row adds its moments to the fold in which it becomes
known, running sums of the moments over the folds are the expanding fits, and one table
with a row per (symbol, fold) holds all models.  Models that must see rows are fitted
fold by fold.  Scores, calibrated probabilities, thresholds, cool-down and votes follow
in the same plan; the cool-down runs on across the borders of folds and chunks.

Rows with a missing feature are neither learned from nor scored.  A fold with fewer than
`least` known rows of either class has no model and no scores.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.expr import Expr, lead, ncol
from tidebars.operators import evaluate, folds, ledger
from tidebars.operators.models import classifier, pipeline
from tidebars.plans.features import add_features
from tidebars.plans.layout import Laid, settle

#: A class variance is at least this share of the feature's variance.
FLOOR = 1e-6


@dataclass(frozen=True)
class Model:
    """A named score of one label from some features; kind: bayes, ridge, or a classifier of tidebars.operators.models."""

    name: str
    label: str
    features: tuple[str, ...]
    kind: str = "bayes"
    threshold: float = 0.5
    penalty: float = 1.0


def fold_of(ts: Column, unit: str) -> Column:
    """Number of the calendar unit (year, quarter, month, week, day) that holds ts."""
    days = F.datediff(ts, F.lit("1970-01-05"))
    return {
        "year": F.year(ts), "quarter": F.year(ts) * 4 + F.quarter(ts) - 1, "month": F.year(ts) * 12 + F.month(ts) - 1,
        "week": F.floor(days / 7).cast("int"), "day": days,
    }[unit]


def prepared(laid: Laid, features: dict[str, Expr], labels: dict[str, Expr], horizon: int, unit: str) -> Laid:
    """Features, labels, the fold of each bar and the fold by whose start its labels are known (stored once)."""
    timed = Laid(laid.df.withColumn("_time", F.unix_timestamp("ts").cast("double")), laid.rows, laid.gaps)
    wanted = {**features, **labels, "_seen": lead(ncol("_time"), horizon)}
    rows = add_features(timed, wanted, ["symbol", "chunk", "seq", "bars", "ts", "close"])
    known = fold_of(F.timestamp_seconds("_seen"), unit) + 1
    return Laid(settle(rows.withColumn("fold", fold_of(F.col("ts"), unit)).withColumn("known", known).drop("_seen"), "walk"), laid.rows)


def running(parts: DataFrame, grid: DataFrame) -> DataFrame:
    """parts(symbol, known, ...sums) added up to and with each fold of grid(symbol, fold)."""
    sums = [c for c in parts.columns if c not in ("symbol", "known")]
    all_ = parts.withColumnRenamed("known", "fold").withColumn("_score", F.lit(0)).unionByName(grid.withColumn("_score", F.lit(1)), allowMissingColumns=True)
    so_far = Window.partitionBy("symbol").orderBy("fold").rangeBetween(Window.unboundedPreceding, 0)  # one row for each fold
    return all_.select("symbol", "fold", "_score", *[F.sum(c).over(so_far).alias(c) for c in sums]).filter("_score = 1").drop("_score")


def _learned(rows: DataFrame, model: Model) -> DataFrame:
    whole = [F.col(f).isNotNull() for f in model.features]
    test = F.col("known").isNotNull() & F.col(model.label).isNotNull()
    for w in whole:
        test = test & w
    return rows.filter(test)


def bayes_fits(rows: DataFrame, grid: DataFrame, model: Model, least: int) -> DataFrame:
    """symbol, fold, and columns prior, then mean and variance of each feature in both classes."""
    of = lambda c, v: F.when(F.col(model.label) == c, v)
    sums = [F.count(of(c, F.lit(1))).alias(f"n{c}") for c in (0, 1)]
    sums += [F.sum(of(c, F.col(f) ** p)).alias(f"s{p}_{c}_{i}") for c in (0, 1) for i, f in enumerate(model.features) for p in (1, 2)]
    fits = running(_learned(rows, model).groupBy("symbol", "known").agg(*sums), grid)
    n0, n1 = F.col("n0"), F.col("n1")
    out = [F.log(n1 / n0).alias("prior")]
    for i, _ in enumerate(model.features):
        mean = (F.col(f"s1_0_{i}") + F.col(f"s1_1_{i}")) / (n0 + n1)
        spread = (F.col(f"s2_0_{i}") + F.col(f"s2_1_{i}")) / (n0 + n1) - mean**2
        out += [mean.alias(f"m_{i}"), F.sqrt(spread).alias(f"d_{i}")]
        for c in (0, 1):
            m = F.col(f"s1_{c}_{i}") / F.col(f"n{c}")
            out += [m.alias(f"m{c}_{i}"), F.greatest(F.col(f"s2_{c}_{i}") / F.col(f"n{c}") - m**2, spread * FLOOR).alias(f"v{c}_{i}")]
    return fits.filter((n0 >= least) & (n1 >= least)).select("symbol", "fold", *out)


def _held(f: str, i: int, clip: float) -> Column:
    """A feature, held within `clip` deviations of its mean so far."""
    m, d = F.col(f"m_{i}"), F.col(f"d_{i}")
    return F.greatest(F.least(F.col(f), m + clip * d), m - clip * d)


def bayes_score(model: Model, clip: float) -> Column:
    total = F.col("prior")
    for i, f in enumerate(model.features):
        far = lambda c: (_held(f, i, clip) - F.col(f"m{c}_{i}")) ** 2 / (2 * F.col(f"v{c}_{i}")) + F.log(F.col(f"v{c}_{i}")) / 2
        total = total + far(0) - far(1)
    return 1 / (1 + F.exp(-total))


def ridge_fits(rows: DataFrame, grid: DataFrame, model: Model, least: int) -> DataFrame:
    """symbol, fold, mean and deviation of each feature, and the weights of the standardized ones (w_0: the constant)."""
    p = len(model.features)
    y = F.col(model.label).cast("double")
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("y")]
    sums += [F.sum(f).alias(f"s_{i}") for i, f in enumerate(model.features)] + [F.sum(F.col(f) * y).alias(f"sy_{i}") for i, f in enumerate(model.features)]
    sums += [F.sum(F.col(model.features[i]) * F.col(model.features[j])).alias(f"ss_{i}_{j}") for i, j in pairs]
    fits = running(_learned(rows, model).groupBy("symbol", "known").agg(*sums), grid).filter((F.col("y") >= least) & (F.col("n") - F.col("y") >= least))

    def solve(frames):
        for t in frames:
            out = []
            for r in t.itertuples(index=False):
                mean = np.array([getattr(r, f"s_{i}") for i in range(p)]) / r.n
                cov = np.zeros((p, p))
                for i, j in pairs:
                    cov[i, j] = cov[j, i] = getattr(r, f"ss_{i}_{j}") / r.n - mean[i] * mean[j]
                d = np.sqrt(np.maximum(np.diag(cov), 1e-300))
                xy = (np.array([getattr(r, f"sy_{i}") for i in range(p)]) / r.n - mean * r.y / r.n) / d
                w = np.linalg.solve(cov / np.outer(d, d) + np.eye(p) * model.penalty / r.n, xy)
                out.append((r.symbol, r.fold, r.y / r.n, *mean, *d, *w))
            yield pd.DataFrame(out, columns=names)

    names = ["symbol", "fold", "w_0", *[f"m_{i}" for i in range(p)], *[f"d_{i}" for i in range(p)], *[f"w_{i + 1}" for i in range(p)]]
    kind = rows.schema["symbol"].dataType.simpleString()
    return fits.mapInPandas(solve, f"symbol {kind}, fold int, " + ", ".join(f"{c} double" for c in names[2:]))  # one row for each symbol and fold


def ridge_score(model: Model, clip: float) -> Column:
    total = F.col("w_0")
    for i, f in enumerate(model.features):
        total = total + F.col(f"w_{i + 1}") * (_held(f, i, clip) - F.col(f"m_{i}")) / F.col(f"d_{i}")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


SUMS: dict[str, tuple[Callable, Callable]] = {"bayes": (bayes_fits, bayes_score), "ridge": (ridge_fits, ridge_score)}
_KEEP = ["symbol", "chunk", "seq", "bars", "ts", "close", "fold"]


def _refitted(rows: DataFrame, model: Model, least: int) -> DataFrame:
    """A classifier fitted anew for each fold, on all symbols together; two jobs for each fold."""
    use = [F.col(f).isNotNull() for f in model.features]
    whole = rows
    for u in use:
        whole = whole.filter(u)
    known, out = _learned(rows, model).select(*model.features, model.label, "known"), None
    for fold in sorted(r.fold for r in whole.select("fold").distinct().collect()):  # calendar units
        past = known.filter(F.col("known") <= fold)
        counts = {r[model.label]: r["count"] for r in past.groupBy(model.label).count().collect()}
        if min(counts.get(0, 0), counts.get(1, 0)) < least:
            continue
        fit = pipeline(list(model.features), classifier(model.kind, model.label, **({} if model.kind in ("svm", "logistic") else {"seed": 42}))).fit(past)
        scored = fit.transform(whole.filter(F.col("fold") == fold)).select(*_KEEP, vector_to_array("probability")[1].alias("raw"))
        out = scored if out is None else out.unionByName(scored)
    return out if out is not None else whole.filter("false").select(*_KEEP, F.lit(0.0).alias("raw"))


def scores(rows: DataFrame, models: list[Model], least: int = 50, clip: float = 5.0) -> DataFrame:
    """Keys, side (the label), model, threshold and raw score of every bar that a model of its fold can score."""
    grid = rows.select("symbol", "fold").distinct()
    out = None
    for m in models:
        if m.kind in SUMS:
            fits, score = SUMS[m.kind]
            part = rows.join(fits(rows, grid, m, least), ["symbol", "fold"]).select(*_KEEP, score(m, clip).alias("raw"))
        else:
            part = _refitted(rows, m, least)
        part = part.filter("raw is not null").withColumns({"side": F.lit(m.label), "model": F.lit(m.name), "threshold": F.lit(m.threshold)})
        out = part if out is None else out.unionByName(part)
    return out


def with_cooldown(scored: DataFrame, chunk_rows: int, gap: int) -> DataFrame:
    """`signal`: over the threshold and at least `gap` bars after the last signal of the same symbol, side and model."""
    line = F.concat_ws("\x1f", "symbol", "side", "model")
    hit = scored.withColumn("hit", (F.col("probability") > F.col("threshold")).cast("double"))
    keyed = hit.withColumn("_symbol", F.col("symbol")).withColumn("symbol", line)
    kept = folds.cooldown(Laid(settle(keyed, "hits"), chunk_rows), gap, ["_symbol", *_KEEP[1:], "side", "model", "probability"])
    return kept.withColumnRenamed("_symbol", "symbol").withColumn("signal", F.col("signal").cast("int"))


def votes(signals: DataFrame, over: float = 0.4) -> DataFrame:
    """The mean probability of all models of a side, as a model called ensemble; it has no cool-down."""
    v = signals.groupBy(*_KEEP, "side").agg(F.avg("probability").alias("probability"))
    return v.withColumn("model", F.lit("ensemble")).withColumn("signal", (F.col("probability") > over).cast("int"))


def walk_forward(
    laid: Laid, features: dict[str, Expr], labels: dict[str, Expr], models: list[Model], horizon: int, unit: str = "quarter",
    least: int = 50, clip: float = 5.0, gap: int = 10, over: float = 0.4,
) -> DataFrame:
    """symbol, chunk, seq, bars, ts, close, fold, side, model, probability, signal of every scored bar, the votes of all models among them."""
    rows = prepared(laid, features, labels, horizon, unit)
    scored = scores(rows.df, models, least, clip).withColumn("probability", evaluate.calibrate(F.col("raw")))
    single = settle(with_cooldown(scored, laid.rows, gap), "signals")
    return single.unionByName(votes(single, over))


def walk_ledger(laid: Laid, result: DataFrame, buy: str, sell: str, model: str, factor: float = 1.0) -> DataFrame:
    """Trades of one model's signals: a buy turns a short position, a sell a long one; both at once turn nothing."""
    mine = result.filter(F.col("model") == model)
    side = F.sum(F.when(F.col("side") == buy, F.col("signal")).when(F.col("side") == sell, -F.col("signal")))
    turns = mine.groupBy("symbol", "chunk", "seq").agg(side.cast("double").alias("_side"))
    bars = laid.df.join(turns, ["symbol", "chunk", "seq"], "left").withColumn("_side", F.coalesce("_side", F.lit(0.0)))
    return ledger.reversal_ledger(Laid(settle(bars, "sides"), laid.rows), ncol("_side"), factor)
