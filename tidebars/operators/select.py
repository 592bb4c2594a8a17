"""Feature filters, scores and selection methods; all data work in Spark jobs.

Only tables with one row per feature, feature pair or fold reach the driver.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.expr import Expr, lag, ncol
from tidebars.operators.prep import exact_quantiles
from tidebars.plans.features import add_features
from tidebars.plans.layout import Laid, settle


def unpivot(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.feature", "x.value")


def feature_profile(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row per feature; grouped aggregates combine map-side, quantiles are exact."""
    long = unpivot(df, features, target)
    stats = long.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.skewness("value").alias("skew"),
        F.kurtosis("value").alias("kurtosis"), F.approx_count_distinct("value", 0.01).alias("distinct_about"),
        F.sum(F.col("value").isNull().cast("long")).alias("nulls"), F.corr("value", F.col(target).cast("double")).alias("target_corr"))
    q = exact_quantiles(df, features, [0.25, 0.5, 0.75]).groupBy("feature").pivot("p", [0.25, 0.5, 0.75]).agg(F.first("value"))
    q = settle(q.select("feature", F.col("`0.25`").alias("q1"), F.col("`0.5`").alias("median"), F.col("`0.75`").alias("q3")), "profile")
    iqr = (F.col("q3") - F.col("q1")) * 1.5
    out = long.join(F.broadcast(q), "feature").groupBy("feature").agg(  # one row per feature
        F.avg(((F.col("value") < F.col("q1") - iqr) | (F.col("value") > F.col("q3") + iqr)).cast("double")).alias("outlier_share"))
    return stats.join(q, "feature").join(out, "feature").withColumn("iqr", F.col("q3") - F.col("q1"))


def constant_features(df: DataFrame, features: list[str], threshold: float = 1e-10) -> list[str]:
    sd = df.agg(*[F.stddev_samp(F.col(f).cast("double")).alias(f) for f in features]).first()
    return [f for f in features if sd[f] is None or sd[f] <= threshold]


def _vectors(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    d = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features]).na.drop(subset=features)
    return VectorAssembler(inputCols=features, outputCol="features").transform(d)


def collinear_features(df: DataFrame, features: list[str], limit: float = 0.95) -> list[str]:
    """Of each pair with |corr| over the limit, the one with the lower variance."""
    m = Correlation.corr(_vectors(df, features).select("features"), "features").first()[0].toArray()
    var = df.agg(*[F.var_samp(F.col(f).cast("double")).alias(f) for f in features]).first()
    dropped: list[str] = []
    for i in range(len(features)):
        for j in range(i + 1, len(features)):
            weaker = features[i] if var[features[i]] < var[features[j]] else features[j]
            if abs(m[i][j]) > limit and weaker not in dropped:
                dropped.append(weaker)
    return dropped


def mutual_information(df: DataFrame, features: list[str], label: str, bins: int = 10) -> DataFrame:
    """Binned mutual information with the label: equal-width bins, one count per (feature, bin, label)."""
    long = unpivot(df, features, label).filter("value is not null")
    lim = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    joint = long.join(F.broadcast(lim), "feature").groupBy("feature", F.coalesce(b, F.lit(0)).alias("bin"), F.col(label).alias("label")).agg(  # one row per feature
        F.count(F.lit(1)).cast("double").alias("n"))
    f, fb, fl = Window.partitionBy("feature"), Window.partitionBy("feature", "bin"), Window.partitionBy("feature", "label")
    t, nb, nl = F.sum("n").over(f), F.sum("n").over(fb), F.sum("n").over(fl)  # at most bins x labels rows per feature
    return joint.select("feature", (F.col("n") / t * F.log(F.col("n") * t / (nb * nl))).alias("part")).groupBy("feature").agg(F.sum("part").alias("mi"))


def autocorrelation_top(laid: Laid, x: Expr, lags: int = 99, k: int = 5) -> DataFrame:
    """The k lags with the largest |correlation| of a series with itself, per symbol."""
    feats = {"x": x, **{f"l{i}": lag(x, i) for i in range(1, lags + 1)}}
    d = add_features(laid, feats, ["symbol"])
    row = d.groupBy("symbol").agg(*[F.corr("x", f"l{i}").alias(f"l{i}") for i in range(1, lags + 1)])
    pairs = F.array(*[F.struct(F.lit(i).alias("lag"), F.col(f"l{i}").alias("corr")) for i in range(1, lags + 1)])
    long = row.select("symbol", F.explode(pairs).alias("p")).select("symbol", "p.*")
    w = Window.partitionBy("symbol").orderBy(F.abs("corr").desc(), "lag")  # <= lags rows
    return long.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def direction_importance(laid: Laid, features: list[str], actual: str, predicted: str) -> DataFrame:
    """|corr| of each feature with 'the predicted direction was right', in one pass."""
    from tidebars.functions.expr import signx, when

    a, p = ncol(actual), ncol(predicted)
    right = when(signx(a - lag(a)).eq(signx(p - lag(p))), 1.0, otherwise=0.0)
    d = add_features(laid, {"right": right}, ["symbol", *features])
    row = d.agg(*[F.abs(F.corr(F.col(f).cast("double"), "right")).alias(f) for f in features])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("score")) for f in features])).alias("x")).select("x.*")


# --- model-based scores (MLlib) --------------------------------------------------------------
def _forest(is_class: bool, trees: int, label: str, seed: int = 42):
    cls = RandomForestClassifier if is_class else RandomForestRegressor
    return cls(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=8, seed=seed)


def forest_importance(df: DataFrame, features: list[str], label: str, is_class: bool, trees: int = 100) -> dict[str, float]:
    model = _forest(is_class, trees, label).fit(_vectors(df, features, label))
    return dict(zip(features, model.featureImportances.toArray().tolist()))


def select_mutual_information(df, features, label, target_count: int) -> list[str]:
    scores = mutual_information(df, features, label).orderBy(F.col("mi").desc(), "feature").limit(target_count).collect()
    return [r["feature"] for r in scores]


def select_recursive(df, features, label, is_class, target_count: int, step: int = 5) -> list[str]:
    """Drop the weakest ``step`` features of a forest until the target count is left."""
    left = list(features)
    while len(left) > target_count:
        imp = forest_importance(df, left, label, is_class, 20)
        n = min(step, len(left) - target_count)
        for f in sorted(left, key=lambda f: (imp[f], f))[:n]:
            left.remove(f)
    return left


def select_regularised(df, features, label, is_class, target_count: int, reg=0.01, ratio=1.0) -> list[str]:
    """Non-zero coefficients of an L1 or elastic-net fit on standardised features, by size."""
    v = _vectors(df, features, label)
    v = StandardScaler(inputCol="features", outputCol="z", withMean=True).fit(v).transform(v)
    cls = LogisticRegression if is_class else LinearRegression
    m = cls(featuresCol="z", labelCol=label, regParam=reg, elasticNetParam=ratio, maxIter=50).fit(v)
    coef = (m.coefficientMatrix.toArray()[0] if is_class and not m.coefficientMatrix is None else m.coefficients.toArray())
    ranked = sorted(((abs(c), f) for c, f in zip(coef, features) if abs(c) > 1e-12), reverse=True)
    return [f for _, f in ranked[:target_count]]


def select_forest(df, features, label, is_class, target_count: int) -> list[str]:
    imp = forest_importance(df, features, label, is_class)
    return sorted(features, key=lambda f: (-imp[f], f))[:target_count]


def ensemble_rank(scores: DataFrame, methods: int = 4) -> DataFrame:
    """Rows (method, feature, score, chosen) -> 0.6 * votes / methods + 0.4 * mean normalised score."""
    top = scores.groupBy("method").agg(F.max("score").alias("_top"))
    s = scores.join(F.broadcast(top), "method")  # one row per method
    return s.groupBy("feature").agg(
        (0.6 * F.sum(F.col("chosen").cast("double")) / methods + 0.4 * F.sum(F.coalesce(F.try_divide("score", "_top"), F.lit(0.0))) / methods).alias("rank_score"))


def fold_scores(df: DataFrame, features: list[str], label: str, is_class: bool, folds: int = 5) -> list[float]:
    """Accuracy or negative squared error on expanding time folds (column ``fold``, -1 = train only)."""
    v = _vectors(df, features, label, "fold").cache()
    out = []
    for k in range(folds):
        train, test = v.filter(F.col("fold") < k), v.filter(F.col("fold") == k)
        pred = _forest(is_class, 20, label).fit(train).transform(test)
        ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy") if is_class else RegressionEvaluator(labelCol=label, metricName="mse")
        s = ev.evaluate(pred)
        out.append(s if is_class else -s)
    v.unpersist()
    return out


def best_method(scores: dict[str, list[float]], default: str = "ensemble") -> str:
    means = {m: sum(s) / len(s) for m, s in scores.items() if s}
    return max(means, key=means.get) if means else default


def importance_stability(df: DataFrame, features: list[str], label: str, is_class: bool, folds: int = 5, trees: int = 20) -> DataFrame:
    """Mean, deviation, variation and slope of forest importance over time folds."""
    rows = []
    for k in range(folds):
        imp = forest_importance(df.filter(F.col("fold") <= k), features, label, is_class, trees)
        rows += [(f, k, float(v)) for f, v in imp.items()]
    r = df.sparkSession.createDataFrame(rows, "feature string, fold int, importance double")
    return r.groupBy("feature").agg(
        F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std"),
        F.try_divide(F.stddev_pop("importance"), F.avg("importance")).alias("variation"), F.regr_slope("importance", "fold").alias("slope"))


def unstable_features(df, features, label, is_class, limit: float = 1.0, splits: int = 3) -> list[str]:
    s = importance_stability(df, features, label, is_class, splits).filter(F.col("variation") > limit)
    return [r["feature"] for r in s.select("feature").collect()]


def filter_cascade(df, features, label, is_class, corr_limit=0.95, cv_limit=1.0) -> dict[str, list[str]]:
    """Constant, then collinear, then unstable features; what is left after each step."""
    gone = constant_features(df, features)
    a = [f for f in features if f not in gone]
    gone = collinear_features(df, a, corr_limit)
    b = [f for f in a if f not in gone]
    gone = unstable_features(df, b, label, is_class, cv_limit)
    return {"all": list(features), "varying": a, "independent": b, "stable": [f for f in b if f not in gone]}


def permutation_importance(df: DataFrame, model, features: list[str], label: str, is_class: bool, seed: int = 42) -> DataFrame:
    """Loss of score of a fitted pipeline when one feature's values are swapped between rows.

    The swap is a join of two random orders by position inside small random
    blocks, so no global shuffle of one column through one task is needed."""
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy") if is_class else RegressionEvaluator(labelCol=label, metricName="mse")
    d = settle(df.select(label, *features).na.drop().withColumn("_b", (F.rand(seed) * 64).cast("int")), "perm")
    base = ev.evaluate(model.transform(d))
    w1, w2 = Window.partitionBy("_b").orderBy(F.xxhash64(*features)), Window.partitionBy("_b").orderBy(F.xxhash64(*features, F.lit(1)))
    a = settle(d.withColumn("_i", F.row_number().over(w1)).withColumn("_j", F.row_number().over(w2)), "perm")
    rows = []
    for f in features:
        other = a.select("_b", F.col("_j").alias("_i"), F.col(f).alias("_x"))
        p = a.join(other, ["_b", "_i"]).withColumn(f, F.col("_x"))
        s = ev.evaluate(model.transform(p))
        rows.append((f, float(base - s if is_class else s - base)))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def feature_report(scores: DataFrame, top: int = 20) -> DataFrame:
    """Top features per measure and the union of them, with how often each is named."""
    w = Window.partitionBy("measure").orderBy(F.col("score").desc(), "feature")  # one row per feature
    best = scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)
    return best.groupBy("feature").agg(F.count(F.lit(1)).alias("named"), F.min("place").alias("best_place"))
