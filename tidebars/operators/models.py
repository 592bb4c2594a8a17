"""Tree and linear models on MLlib, stacking, scoring, time-fold cross-validation."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.plans.layout import settle


def regressor(kind: str, label: str = "label", **kw):
    table = {"forest": RandomForestRegressor, "boosting": GBTRegressor, "linear": LinearRegression}
    return table[kind](featuresCol="features", labelCol=label, **kw)


def classifier(kind: str, label: str = "label", layers=None, **kw):
    table = {"forest": RandomForestClassifier, "boosting": GBTClassifier, "svm": LinearSVC, "logistic": LogisticRegression}
    if kind == "perceptron":
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=layers, **kw)
    return table[kind](featuresCol="features", labelCol=label, **kw)


def pipeline(features: list[str], model) -> Pipeline:
    """Missing values become the training median; every row keeps its score."""
    filled = [f"{f}__filled" for f in features]
    fill = Imputer(inputCols=features, outputCols=filled, strategy="median")
    return Pipeline(stages=[fill, VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep"), model])


def stacked_predictions(df: DataFrame, features: list[str], label: str, kinds=("forest", "boosting"), folds: int = 3) -> DataFrame:
    """Out-of-fold predictions of base models as columns (column ``fold``; -1 only trains)."""
    parts = None
    for k in range(folds):
        train, test = df.filter(F.col("fold") < k), df.filter(F.col("fold") == k)
        for kind in kinds:
            m = pipeline(features, regressor(kind, label, seed=42)).fit(train)
            test = m.transform(test).withColumnRenamed("prediction", f"p_{kind}").drop("features")
        parts = test if parts is None else parts.unionByName(test)
    return settle(parts, "stacked")


def stack(df: DataFrame, features: list[str], label: str, kinds=("forest", "boosting"), folds: int = 3):
    """Linear model over the out-of-fold predictions; returns (meta model, its training table)."""
    p = stacked_predictions(df, features, label, kinds, folds)
    meta = pipeline([f"p_{k}" for k in kinds], regressor("linear", label)).fit(p)
    return meta, p


def choose_by_time_folds(df: DataFrame, features: list[str], label: str, kind: str = "forest", grid: dict | None = None, is_class=True):
    """Parameter choice by cross-validation on the time folds of column ``fold``."""
    est = classifier(kind, label) if is_class else regressor(kind, label)
    b = ParamGridBuilder()
    for name, values in (grid or {"maxDepth": [4, 8]}).items():
        b = b.addGrid(est.getParam(name), values)
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="logLoss") if is_class else RegressionEvaluator(labelCol=label)
    rows, filled = df.filter("fold >= 0"), [f"{f}__filled" for f in features]
    rows = Imputer(inputCols=features, outputCols=filled, strategy="median").fit(rows).transform(rows)
    d = VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep").transform(rows)
    n = d.agg(F.max("fold")).first()[0] + 1
    return CrossValidator(estimator=est, estimatorParamMaps=b.build(), evaluator=ev, numFolds=n, foldCol="fold").fit(d)


def score(model, df: DataFrame, keys: list[str], over: float = 0.5) -> DataFrame:
    """Probability of the positive class and the signal, per row."""
    p = model.transform(df).withColumn("probability", vector_to_array("probability")[1])
    return p.select(*keys, "probability", (F.col("probability") > over).alias("signal"))


def score_with(df: DataFrame, predict, features: list[str], keys: list[str]) -> DataFrame:
    """Scoring by a foreign model: ``predict(frame) -> array``, called once per Arrow batch."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def run(batches):
        for b in batches:
            out = b[keys].copy()
            out["probability"] = predict(b[features])
            yield out

    return df.select(*keys, *[f for f in features if f not in keys]).mapInPandas(run, f"{fields}, probability double")
