import math

import pytest

from tidebars.functions.expr import C, V, ema, lag, signal, sma, true, when
from tidebars.operators.strategies import parametric
from tidebars.plans.features import add_features
from tidebars.plans.layout import lay_out

NAN = float("nan")
CLOSE = [10.0, 11, None, 13, 14, NAN, 16, 15, 14, 13, None, None, 10, 12, 14, 16, 18, 20, NAN, 24, 25, 26, 24, 22, 21]


@pytest.fixture(scope="module")
def bars(spark):
    rows = [("A", i, None if c is None else float(c)) for i, c in enumerate(CLOSE)] + [("B", i, float(i)) for i in range(7)]
    df = spark.createDataFrame(rows, "symbol string, i int, close double")
    return df.selectExpr("symbol", "timestamp_seconds(86400 * i) AS ts", "close AS open", "close AS high", "close AS low", "close", "cast(i as double) AS volume")


def known(x):
    return x is not None and not math.isnan(x)


@pytest.mark.parametrize("rows", [3, 7, 64, 1000])
def test_missing_prices(bars, rows):
    wanted = {"sma3": sma(C, 3), "ema": ema(C, 3), "rule": signal(C > 12.0, C < 12.0), "step": when(true(C > lag(C)), 1.0, otherwise=0.0), "vol": sma(V, 2)}
    got = [r for r in add_features(lay_out(bars, rows), wanted).orderBy("symbol", "seq").collect() if r.symbol == "A"]
    y = None
    for i, r in enumerate(got):
        frame = CLOSE[max(0, i - 2) : i + 1]
        full = len(frame) == 3 and all(map(known, frame))
        assert (r.sma3 == pytest.approx(sum(frame) / 3)) if full else r.sma3 is None
        if known(CLOSE[i]):
            y = CLOSE[i] if y is None else y + (CLOSE[i] - y) * 0.5
        assert r.ema == pytest.approx(y)
        assert r.rule == ((CLOSE[i] > 12) - (CLOSE[i] < 12) if known(CLOSE[i]) else 0)
        assert r.step == float(i > 0 and known(CLOSE[i]) and known(CLOSE[i - 1]) and CLOSE[i] > CLOSE[i - 1])


def test_parameters_are_checked():
    assert parametric.build("rsi") is parametric.build("rsi", n=14)
    assert parametric.build("rsi", n=21) is not parametric.build("rsi")
    with pytest.raises(TypeError):
        parametric.build("rsi", length=3)


def test_every_row_is_scored(spark):
    from tidebars.operators import models

    rows = [(i, None if i % 7 == 0 else float(i % 10), NAN if i % 11 == 0 else float(i % 3), int(i % 10 > 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a double, b double, label int")
    model = models.pipeline(["a", "b"], models.classifier("forest", seed=1)).fit(df)
    got = models.score(model, df, ["id"])
    assert got.count() == 200 and got.filter("probability is null").count() == 0


def test_quiet_chunks_need_one_round(spark):
    """One signal among many chunks: the state it leaves is forgotten, so no chunk runs twice."""
    from tidebars.operators import folds

    df = spark.range(600).selectExpr("'S' AS symbol", "timestamp_seconds(60 * id) AS ts", "1D AS close", "cast(id = 5 AS double) AS hit")
    laid = lay_out(df, 10)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quiet", "quiet")
    out = folds.cooldown(laid, 3).filter("signal = 1").collect()
    jobs = len(tracker.getJobIdsForGroup("quiet"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r.seq for r in out] == [5]
    assert jobs <= 16
