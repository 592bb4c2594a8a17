"""Walk-forward: no look-ahead, the fits beside plain versions, and independence of chunks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.functions.expr import C, lag, lead, true, when
from tidebars.operators import walk_forward as W
from tidebars.plans.layout import Laid, lay_out, settle

FEATURES = {"c1": C / lag(C) - 1.0, "c5": C / lag(C, 5) - 1.0}
AHEAD = lead(C, 3) / C - 1.0
LABELS = {"buy": when(true(AHEAD > 0.0), 1, true(AHEAD.eq(AHEAD)), 0)}
START = dt.datetime(2020, 1, 1)


def prices(n=420, seed=1):
    return 100 * np.exp(np.random.default_rng(seed).normal(size=n).cumsum() / 50)


def laid_of(spark, series, rows=64):
    data = [(name, START + dt.timedelta(days=i), float(v), float(v), float(v), float(v), 1.0) for name, x in series.items() for i, v in enumerate(x)]
    laid = lay_out(spark.createDataFrame(data, "symbol string, ts timestamp, open double, high double, low double, close double, volume double"), rows)
    return Laid(settle(laid.df, "test"), rows)


def run(laid, kinds=("bayes", "ridge"), **kw):
    models = [W.Model(k, "buy", tuple(FEATURES), k) for k in kinds]
    d = W.walk_forward(laid, FEATURES, LABELS, models, 3, "month", **{"least": 20, "gap": 5, **kw}).toPandas()
    return d.sort_values(["symbol", "model", "seq"], ignore_index=True)


@pytest.fixture(scope="module")
def scored(spark):
    return run(laid_of(spark, {"A": prices(), "B": prices(300, 2)}))


def test_shuffling_the_future_changes_no_past_row(spark, scored):
    x = prices()
    cut = 300
    later = np.r_[x[:cut], np.random.default_rng(9).permutation(x[cut:])]
    other = run(laid_of(spark, {"A": later, "B": prices(300, 2)}))
    keys = ["symbol", "model", "seq", "probability", "signal"]
    past = lambda d: d[(d["symbol"] == "B") | (d["seq"] < cut)][keys].reset_index(drop=True)
    assert past(scored).equals(past(other)) and len(past(scored)) > 300
    after = lambda d: d[(d["symbol"] == "A") & (d["seq"] >= cut)]["probability"].to_numpy()
    assert not np.allclose(after(scored), after(other))


def test_chunks_do_not_matter(spark, scored):
    other = run(laid_of(spark, {"A": prices(), "B": prices(300, 2)}, 1000))
    keys = ["symbol", "model", "seq", "fold", "signal"]
    assert scored[keys].equals(other[keys]) and np.allclose(scored["probability"], other["probability"])


def plain(x, kind, least=20, clip=5.0):
    """Bar by bar: the model of a month from all labels that were complete before it."""
    n = len(x)
    feats = np.full((n, 2), np.nan)
    feats[1:, 0], feats[5:, 1] = x[1:] / x[:-1] - 1, x[5:] / x[:-5] - 1
    y = np.full(n, np.nan)
    y[:-3] = x[3:] / x[:-3] > 1
    month = np.array([(START + dt.timedelta(days=i)).year * 12 + (START + dt.timedelta(days=i)).month for i in range(n)])
    out = {}
    for i in range(5, n):
        past = [j for j in range(5, n - 3) if month[j + 3] < month[i]]
        a, b = feats[past], y[past]
        if min((b == 1).sum(), (b == 0).sum()) < least:
            continue
        m, d = a.mean(0), a.std(0)
        v = np.clip(feats[i], m - clip * d, m + clip * d)
        if kind == "bayes":
            far = [(((v - a[b == c].mean(0)) ** 2) / (2 * a[b == c].var(0)) + np.log(a[b == c].var(0)) / 2).sum() for c in (0, 1)]
            p = 1 / (1 + np.exp(-(np.log((b == 1).sum() / (b == 0).sum()) + far[0] - far[1])))
        else:
            z = (a - m) / d
            w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (b - b.mean()))
            p = np.clip(b.mean() + w @ ((v - m) / d), 0, 1)
        out[i] = 1 / (1 + np.exp(-(2 * p - 1)))
    return out


@pytest.mark.parametrize("kind", ["bayes", "ridge"])
@pytest.mark.parametrize("symbol", ["A", "B"])
def test_scores_equal_a_plain_version(scored, kind, symbol):
    want = plain(prices() if symbol == "A" else prices(300, 2), kind)
    got = scored[(scored["symbol"] == symbol) & (scored["model"] == kind)].set_index("seq")["probability"]
    assert list(got.index) == sorted(want) and np.allclose(got, [want[i] for i in sorted(want)], atol=1e-9)


def test_cooldown_runs_across_folds_and_votes_have_none(scored):
    for (_, model), d in scored.groupby(["symbol", "model"]):
        d = d.set_index("seq")
        if model == "ensemble":
            assert (d["signal"] == (d["probability"] > 0.4)).all()
            continue
        last, want = -99, []
        for seq, p in d["probability"].items():
            hit = p > 0.5 and seq - last >= 5
            last = seq if hit else last
            want.append(int(hit))
        assert d["signal"].tolist() == want and 0 < sum(want) < len(want)
    votes = scored.groupby(["symbol", "seq", "side"]).apply(lambda d: abs(d[d["model"] == "ensemble"]["probability"].iloc[0] - d[d["model"] != "ensemble"]["probability"].mean()), include_groups=False)
    assert votes.max() < 1e-12


def test_refitted_forest_sees_no_future(spark):
    x = prices(200)
    a = run(laid_of(spark, {"A": x}), ("forest",))
    b = run(laid_of(spark, {"A": np.r_[x[:150], x[150:][::-1]]}), ("forest",))
    first = lambda d: d[d["seq"] < 150][["seq", "model", "probability", "signal"]].reset_index(drop=True)
    assert len(first(a)) and first(a).equals(first(b))


def test_too_few_rows_give_no_scores(spark):
    assert run(laid_of(spark, {"A": prices(30)})).empty
    flat = run(laid_of(spark, {"A": np.full(200, 5.0)}))
    assert flat.empty


def test_ledger_turns_on_opposite_signals(spark):
    laid = laid_of(spark, {"A": np.arange(1.0, 31.0)}, 8)
    marks = {3: "buy", 7: "sell", 9: "sell", 12: "buy", 20: "buy", 20.5: "sell", 25: "sell"}
    keys = laid.df.select("symbol", "chunk", "seq")
    result = keys.join(spark.createDataFrame([(int(k), v, 1, "m") for k, v in marks.items()], "seq bigint, side string, signal int, model string"), "seq")
    got = sorted((r.side, r.entry_seq, r.exit_seq, r.pnl) for r in W.walk_ledger(laid, result, "buy", "sell", "m").collect())
    assert got == [("long", 3, 7, 4.0), ("long", 12, 25, 13.0), ("short", 7, 12, -5.0), ("short", 25, None, None)]
