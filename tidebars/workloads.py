"""Queries over the driver's tables that go beyond one feature table.

Each takes (spark, folder) and returns a DataFrame; see the SQL of the same
name for the plain definition.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.functions.expr import C, H, L, SEQ, cross_dn, cross_up, ema, glob, lag, lead, ncol, pct, roll, run, sma, true, when
from tidebars.operators import cross_asset as X
from tidebars.operators import folds, labels, ledger
from tidebars.operators.indicators import rsi
from tidebars.plans.features import add_features
from tidebars.plans.layout import Laid, lay_out, settle
from tidebars.plans.shelf import shelf
from tidebars.sources import bars as B

STAMP = "yyyy-MM-dd HH:mm:ss"


def cut(x, digits=4):
    """Decimals are cut at a threshold off the decimal grid, so that engine
    round-off in the last bits cannot change the result."""
    s = float(10**digits)
    return (F.floor(x * F.lit(s) + F.lit(0.4871)) / F.lit(s)).cast("double")


def stamp(c="ts"):
    return F.date_format(c, STAMP)


def _rounded(df, keys, values, digits=4):
    return df.select(*keys, *[cut(F.col(v), digits).alias(v) for v in values])


# --- bars ---------------------------------------------------------------------------
def bars_of(name):
    def run_(spark, sf):
        df = B.adapter(spark, sf, name)
        return _rounded(df.withColumn("ts", stamp()), ["symbol", "ts"], list(B.PRICE_COLUMNS))

    return run_


def resample_weekly(spark, sf):
    df = B.resample(B.adapter(spark, sf, "flag_daily"), "week")
    return _rounded(df.withColumn("ts", stamp()), ["symbol", "ts"], list(B.PRICE_COLUMNS))


def resample_monthly_last(spark, sf):
    df = B.resample_last(B.adapter(spark, sf, "flag_daily"), "month")
    return _rounded(df.select("symbol", stamp("period").alias("period"), stamp().alias("ts"), *B.PRICE_COLUMNS),
                    ["symbol", "period", "ts"], list(B.PRICE_COLUMNS))


def tail_bars(spark, sf):
    df = B.tail_bars(B.adapter(spark, sf, "flag_daily"), 500)
    return _rounded(df.withColumn("ts", stamp()), ["symbol", "ts"], list(B.PRICE_COLUMNS))


def gap_report(spark, sf):
    return B.gap_report(B.adapter(spark, sf, "flag_daily"))


# --- joins --------------------------------------------------------------------------
def pair_ratio(spark, sf):
    p = X.pair_bars(B.adapter(spark, sf, "flag_daily"), "A", "N")
    return p.select(stamp().alias("ts"), cut(F.col("close_a") / F.col("close_b")).alias("ratio"), cut(F.col("close_a") - F.col("close_b")).alias("spread"))


def unmatched_times(spark, sf):
    return X.unmatched_times(B.adapter(spark, sf, "combo_daily"), "AF", "RF")


def macro_asof(spark, sf):
    df = B.adapter(spark, sf, "macro_daily")
    return _rounded(df.withColumn("ts", stamp()), ["symbol", "ts"], ["close", *B.MACRO_COLUMNS])


def statements_asof(spark, sf):
    """Monthly turnover by symbol, known ten days after the month; a second version of the same day counts."""
    from tidebars.operators.asof import asof_by_symbol

    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    month = lines.groupBy(F.col("l_returnflag").alias("symbol"), F.date_trunc("month", "l_shipdate").alias("m")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("turnover"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"))
    out = F.explode(F.array(F.struct(F.lit(1).alias("version"), F.col("turnover").alias("value")), F.struct(F.lit(2).alias("version"), (F.col("turnover") - F.col("tax")).alias("value")))).alias("r")
    # The revised version is missing for the symbol R.
    ref = month.select("symbol", F.expr("add_months(m, 1) + interval 10 days").cast("timestamp").alias("ts"), out).select("symbol", "ts", "r.*").filter("version = 1 or symbol <> 'R'")
    d = asof_by_symbol(shelf(spark, sf, "flag_daily").df.select("symbol", "ts", "close"), ref, ["value", "version"], ("version",), most=500)
    return _rounded(d.select("symbol", stamp().alias("ts"), stamp("ref_ts").alias("known"), "version", "value"), ["symbol", "ts", "known", "version"], ["value"], 1)


def rolling_order_statistics(spark, sf):
    from tidebars.operators.rolling import rolling_quantiles

    wanted = {"median_10": (10, 0.5), "median_300": (300, 0.5), "low_300": (300, 0.05), "high_300": (300, 0.9)}
    return _rounded(rolling_quantiles(shelf(spark, sf, "flag_daily"), "close", wanted, ["symbol", "ts"]).withColumn("ts", stamp()), ["symbol", "ts"], list(wanted))


def rolling_callables(spark, sf):
    """Any function of a window: the rank of the last close, the deviation of 250, the dearest volume-weighted price."""
    from tidebars.operators.rolling import rolling_apply, rolling_deviation

    laid = shelf(spark, sf, "flag_daily")
    rank = rolling_apply(laid, ["close"], 30, "rank", lambda w: (w <= w[:, -1:]).mean(axis=1), ["symbol", "ts"])
    spread = rolling_deviation(laid, "close", 250, "spread", ["symbol", "ts"])
    paid = rolling_apply(laid, ["close", "volume"], 15, "paid", lambda w: (w[:, 0] * w[:, 1]).sum(axis=1) / w[:, 1].sum(axis=1), ["symbol", "ts"])
    d = rank.join(spread, ["symbol", "ts"]).join(paid, ["symbol", "ts"])
    return _rounded(d.withColumn("ts", stamp()), ["symbol", "ts"], ["rank", "spread", "paid"])


def running_growth(spark, sf):
    """Product of the growth since the first bar, with the sign of a short side on Mondays."""
    from tidebars.operators.rolling import running_product

    laid = shelf(spark, sf, "flag_daily")
    signed = Laid(laid.df.withColumn("side", F.when(F.dayofweek("ts") == 2, -1.0).otherwise(1.0)), laid.rows)
    d = running_product(signed, C / lag(C) * ncol("side"), "growth", ["symbol", "ts"])
    return _rounded(d.withColumn("ts", stamp()), ["symbol", "ts"], ["growth"])


def back_filled(spark, sf):
    """Closes of quiet days are taken from the next busy day, volumes at most two bars later."""
    from tidebars.operators.rolling import back_fill

    laid = shelf(spark, sf, "flag_daily")
    holes = laid.df.withColumns({"close": F.when(F.col("volume") % 3 == 0, F.col("close")), "volume": F.when(F.col("volume") % 3 == 0, F.col("volume"))})
    d = back_fill(Laid(holes, laid.rows), ["close"], ["symbol", "ts"]).join(back_fill(Laid(holes, laid.rows), ["volume"], ["symbol", "ts"], 2), ["symbol", "ts"])
    return _rounded(d.withColumn("ts", stamp()), ["symbol", "ts"], ["close", "volume"])


def favourites_short(spark, sf):
    fav = spark.read.parquet(f"{sf}/supplier.parquet").filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("symbol"))
    return X.short_favourites(B.adapter(spark, sf, "part_daily"), fav).withColumn("ts", stamp())


def breadth_count(spark, sf):
    laid = shelf(spark, sf, "combo_daily")
    up = add_features(laid, {"above": true(C > sma(C, 20))}, ["symbol", "ts"])
    return X.breadth(up, "above").withColumn("ts", stamp())


def rotation_argmax(spark, sf):
    laid = shelf(spark, sf, "combo_daily")
    r = add_features(laid, {"ret": pct(C, 20)}, ["symbol", "ts"]).filter("ret is not null")
    return X.best_asset(r, "ret").select(stamp().alias("ts"), "symbol", cut(F.col("ret")).alias("ret"))


def top_n_momentum(spark, sf):
    laid = shelf(spark, sf, "flag_daily")
    r = add_features(laid, {"ret": pct(C, 6)}, ["symbol", "ts"])
    return X.top_per_period(r, "ret", "month", 10).select("symbol", stamp().alias("ts"), F.col("place").cast("int").alias("place"), cut(F.col("ret")).alias("ret"))


def signal_merge(spark, sf):
    laid = shelf(spark, sf, "flag_daily")
    d = add_features(laid, {"a": when(true(C > sma(C, 5)), 1, true(C < sma(C, 5)), -1), "b": when(true(C > sma(C, 20)), 1)}, ["symbol", "ts"])
    parts = [d.select("symbol", "ts", F.lit("ma").alias("strategy"), F.col(c).alias("signal")) for c in ("a", "b")]
    return X.merge_signals(parts).select("symbol", stamp().alias("ts"), "strategy", F.col("signal").cast("double").alias("signal"))


def portfolio_weighted(spark, sf):
    laid = shelf(spark, sf, "panel_daily")
    from tidebars.operators.cross_asset import C2, C3

    feats = {"ret": pct(C) * 0.4 + pct(C2) * 0.4 + pct(C3) * 0.2, "beta": X.roll("covar_samp", pct(C), 60, y=pct(C2)) / X.roll("var_samp", pct(C2), 60)}
    return _rounded(add_features(laid, feats, ["ts"]).withColumn("ts", stamp()), ["ts"], list(feats))


# --- screens ---------------------------------------------------------------------------
def _parts(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet")


def growth_screen(spark, sf):
    p = _parts(spark, sf).select(
        F.col("p_brand").alias("symbol"), F.col("p_partkey").alias("period"), F.col("p_size").alias("eps_growth_qtr"),
        F.col("p_size").alias("eps_growth_ann"), F.lit(1).alias("new_product"), (F.col("p_retailprice") / 600).alias("price_strength"),
        (F.col("p_retailprice") / 10).alias("relative_strength"), (F.col("p_size") / 50.0).alias("institutional"),
        F.when(F.col("p_type") == "ECONOMY", "Bull").otherwise("Bear").alias("market_trend"))
    return X.growth_screen(p).select("symbol", "period", "signal")


def market_screen(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(
        "c_custkey", F.col("c_mktsegment").alias("country"), (F.col("c_acctbal") / 500).alias("annual_return"))
    return X.market_screen(c, ["BUILDING", "MACHINERY"]).select("c_custkey", "signal")


def value_growth_screen(spark, sf):
    p = _parts(spark, sf).select("p_partkey", (F.col("p_size") / 50.0).alias("pe_ratio"), (F.col("p_retailprice") / 20000 - 0.05).alias("growth_rate"))
    return X.value_growth_screen(p).select("p_partkey", "signal")


def ten_bagger_screen(spark, sf):
    p = _parts(spark, sf).select(
        "p_partkey", F.col("p_retailprice").alias("close"), (F.col("p_size") * 4.0 - 8).alias("earnings"),
        (F.col("p_size") - 25).alias("earnings_growth"), (F.col("p_size") * 5.0).alias("purchase_price"))
    return X.ten_bagger_screen(p).select("p_partkey", "signal")


def top_yield(spark, sf):
    p = _parts(spark, sf).select(F.col("p_partkey").cast("string").alias("symbol"), (F.col("p_size") / F.col("p_retailprice")).alias("dividend_yield"))
    return X.top_yield(p, 10).select("symbol", "signal")


def implied_over_realised(spark, sf):
    p = _parts(spark, sf).select(
        "p_partkey", (F.col("p_size") / 50.0).alias("implied"), (F.col("p_retailprice") / 3000).alias("realised"), F.lit(0.4).alias("sector_realised"))
    return X.implied_over_realised(p).select("p_partkey")


def custom_predicates(spark, sf):
    b = B.adapter(spark, sf, "flag_daily")
    out = X.custom_rule(b, lambda d: d["close"] > d["open"] * 1.5, lambda d: d["close"] < d["open"] * 0.5)
    return out.select("symbol", stamp().alias("ts"), "signal")


# --- sessions and seasons ----------------------------------------------------------------
def session_breakout(spark, sf):
    """First-hour range of each New York day against its later bars."""
    from tidebars.operators.sessions import first_hour_breakout

    out = first_hour_breakout(B.adapter(spark, sf, "events_hourly"), "America/New_York", 570, 691)
    return out.select("symbol", stamp().alias("ts"), "signal")


def seasonality_frequency(spark, sf):
    from tidebars.operators.sessions import up_month_frequency

    return _rounded(up_month_frequency(shelf(spark, sf, "flag_daily")), ["symbol", "month"], ["frequency"])


def seasonal_signal(spark, sf):
    from tidebars.operators.sessions import seasonal_signals

    return seasonal_signals(shelf(spark, sf, "flag_daily"), 0.51, 0.49).select("symbol", stamp().alias("ts"), "signal")


def adaptive_cyber_cycle(spark, sf):
    from tidebars.operators.sessions import cycle_signals

    return cycle_signals(shelf(spark, sf, "flag_daily")).select("symbol", stamp().alias("ts"), "period", "signal")


# --- folds -----------------------------------------------------------------------------------
def psar(spark, sf):
    d = folds.parabolic(shelf(spark, sf, "flag_daily"))
    return d.select("symbol", stamp().alias("ts"), cut(F.col("sar")).alias("sar"), F.col("side"),
                    cut(F.col("sar") * F.col("side")).alias("sarext"))


def psar_cross(spark, sf):
    laid = shelf(spark, sf, "flag_daily")
    d = folds.parabolic(laid, keep=["symbol", "ts", "seq", "chunk", "bars", "close"])
    sar = ncol("sar")
    out = add_features(Laid(settle(d, "psar"), laid.rows), {"signal": X.signal(cross_up(C, sar), cross_dn(C, sar))}, ["symbol", "ts"])
    return out.withColumn("ts", stamp())


def hilbert_cycle(spark, sf):
    d = folds.cycles(shelf(spark, sf, "flag_daily"))
    return _rounded(d.withColumn("ts", stamp()), ["symbol", "ts"], folds.CYCLE_OUTPUTS)


def cooldown_signals(spark, sf):
    laid = shelf(spark, sf, "flag_daily")
    hits = add_features(laid, {"hit": when(true(C > sma(C, 20)), 1.0, otherwise=0.0)}, ["symbol", "ts", "seq", "chunk", "bars"])
    d = folds.cooldown(Laid(settle(hits, "hits"), laid.rows), 10)
    return d.filter("signal = 1").select("symbol", stamp().alias("ts"), "seq")


def average_cost_ledger(spark, sf):
    d = folds.double_down(shelf(spark, sf, "flag_daily"))
    return d.select("symbol", stamp().alias("ts"), F.col("signal").cast("int").alias("signal"), cut(F.col("average_cost")).alias("average_cost"))


def scale_in_ledger(spark, sf):
    d = folds.scale_in(shelf(spark, sf, "flag_daily"))
    return d.select("symbol", stamp().alias("ts"), F.col("signal").cast("int").alias("signal"), cut(F.col("average_cost")).alias("average_cost"))


def martingale_ledger(spark, sf):
    d = folds.martingale(shelf(spark, sf, "flag_daily"))
    return d.select("symbol", stamp().alias("ts"), cut(F.col("size")).alias("size"), cut(F.col("pnl"), 2).alias("pnl"))


# --- labels --------------------------------------------------------------------------------------
def best_later_exit(spark, sf):
    d = labels.best_later_exit(shelf(spark, sf, "flag_daily"), "long")
    return d.select("symbol", "seq", F.col("exit_seq").cast("double").alias("exit_seq"), cut(F.col("profit")).alias("profit"))


def _truth(spark, sf):
    laid = shelf(spark, sf, "flag_daily")
    return labels.truth_trades(laid, "long").unionByName(labels.truth_trades(laid, "short"))


def truth_trades_suffix(spark, sf):
    return _truth(spark, sf).select("symbol", "side", "entry_seq", "exit_seq", cut(F.col("profit")).alias("profit"))


def close_marks(spark, sf):
    laid = shelf(spark, sf, "flag_daily")
    t = settle(_truth(spark, sf), "truth")
    return labels.close_marks(laid.df.select("symbol", "seq"), t)


def truth_trades_optimal(spark, sf):
    laid = shelf(spark, sf, "flag_daily")
    t = labels.optimal_trades(laid, "long").unionByName(labels.optimal_trades(laid, "short"))
    return t.select("symbol", "side", "entry_seq", "exit_seq", cut(F.col("profit")).alias("profit"))


# --- ledgers ------------------------------------------------------------------------------------
def _cross_ledger(laid):
    a, b = sma(C, 5), sma(C, 20)
    r = rsi(14, kind="simple")
    return ledger.signal_ledger(laid, cross_up(a, b), cross_dn(a, b), (r > 60.0) | (r < 40.0))


def trade_ledger(spark, sf):
    t = _cross_ledger(shelf(spark, sf, "flag_daily"))
    return t.select("symbol", "side", "entry_seq", F.col("exit_seq").cast("double").alias("exit_seq"), cut(F.col("entry_px")).alias("entry_px"), cut(F.col("exit_px")).alias("exit_px"), cut(F.col("pnl"), 1).alias("pnl"))


def trade_summary(spark, sf):
    t = ledger.trade_summary(_cross_ledger(shelf(spark, sf, "flag_daily")))
    return _rounded(t, ["symbol", "trades", "wins"], ["pnl", "best", "worst"], 1)


def trade_balance(spark, sf):
    t = ledger.balance(_cross_ledger(shelf(spark, sf, "flag_daily")), 10000.0)
    return t.select("symbol", "side", stamp("exit_ts").alias("exit_ts"), cut(F.col("balance"), 1).alias("balance"))


def trade_log(spark, sf):
    t = ledger.trade_log(_cross_ledger(shelf(spark, sf, "flag_daily")))
    return t.select("symbol", stamp().alias("ts"), "action", cut(F.col("price")).alias("price"))


def reversal_ledger(spark, sf):
    a, b = sma(C, 5), sma(C, 20)
    t = ledger.reversal_ledger(shelf(spark, sf, "flag_daily"), when(true(cross_up(a, b)), 1, true(cross_dn(a, b)), -1, otherwise=0))
    return t.select("symbol", "side", "entry_seq", F.col("exit_seq").cast("double").alias("exit_seq"), cut(F.col("pnl")).alias("pnl"))


def market_cross_trades(spark, sf):
    """Flagship: ticks to hourly bars, two means, cross events, ledger."""
    a, b = sma(C, 5), sma(C, 20)
    t = ledger.reversal_ledger(shelf(spark, sf, "events_hourly"), when(true(cross_up(a, b)), 1, true(cross_dn(a, b)), -1, otherwise=0))
    return t.select("symbol", "side", stamp("entry_ts").alias("entry_ts"), stamp("exit_ts").alias("exit_ts"), cut(F.col("pnl")).alias("pnl"))


# --- preparation ------------------------------------------------------------------------------
from tidebars.operators import evaluate, prep, select  # noqa: E402


def exact_quantiles(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    q = prep.exact_quantiles(li, ["l_quantity", "l_extendedprice", "l_discount"], [0.01, 0.25, 0.5, 0.75, 0.99])
    return q.select("feature", "p", cut(F.col("value")).alias("value"))


def winsor_rank_log(spark, sf):
    b = B.adapter(spark, sf, "part_daily")
    d = prep.volume_transforms(settle(b, "bars"))
    return _rounded(d.withColumn("ts", stamp()), ["symbol", "ts"], ["volume_log", "volume_winsor", "volume_rank"], 5)


def robust_scale(spark, sf):
    laid = shelf(spark, sf, "flag_daily")
    d = prep.robust_scale(laid.df, ["close", "volume"], prep.chronological_split(0.8))
    return _rounded(d.withColumn("ts", stamp()), ["symbol", "ts"], ["close", "volume"])


def sliding_windows(spark, sf):
    d = prep.sliding_windows(shelf(spark, sf, "flag_daily"), ["close", "volume"], 30, 5)
    tot = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, v: a + v.cast("double"))
    return d.select("symbol", "seq", F.size("window").alias("len"), cut(tot("window"), 1).alias("total"),
                    cut(F.col("window")[0].cast("double"), 1).alias("first"), cut(F.col("ahead")[4].cast("double"), 1).alias("last_ahead"))


def label_encode(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    d = prep.label_encode(prep.label_encode(o, "o_orderpriority", "priority"), "o_orderstatus", "status")
    return d.select("o_orderkey", "priority", "status")


def skew_fill(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("double")).alias("user"))
    return _rounded(prep.skew_fill(e, ["value", "user"]), ["event_id"], ["value", "user"])


def duplicate_columns(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.col("l_quantity").alias("copy_a"), (F.col("l_tax") + 0.0).alias("copy_b"),
        (F.col("l_tax") + F.when(F.col("l_orderkey") == 0, 1).otherwise(0)).alias("almost"))
    names = prep.duplicate_columns(li, li.columns[2:], ["l_orderkey", "l_linenumber"])
    return spark.createDataFrame([(n,) for n in names], "duplicate string")


def head_rows(spark, sf):
    d = prep.head_rows(shelf(spark, sf, "flag_daily"), 1000, 200)
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first"), cut(F.sum("close"), 2).alias("total"))


def time_folds(spark, sf):
    d = shelf(spark, sf, "flag_daily").df.withColumn("fold", prep.time_folds(5)).withColumn("train", prep.chronological_split())
    return d.groupBy("symbol", "fold", "train").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))


def class_weights(spark, sf):
    d = spark.read.parquet(f"{sf}/labels.parquet")
    return prep.class_weights(d, "quality").select("doc_id", cut(F.col("weight"), 6).alias("weight"))


# --- selection ----------------------------------------------------------------------------------
_FEATURES = ["open", "high", "low", "close", "volume", "mean5", "mean20", "std20", "ret"]


def _feature_table(spark, sf):
    from tidebars.functions.expr import lead, rstd

    feats = {"mean5": sma(C, 5), "mean20": sma(C, 20), "std20": rstd(C, 20), "ret": pct(C), "label": when(true(lead(C) > C), 1, otherwise=0)}
    return add_features(shelf(spark, sf, "flag_daily"), feats, ["symbol", "ts", "seq", "bars", "open", "high", "low", "close", "volume"])


def feature_profile(spark, sf):
    d = settle(_feature_table(spark, sf), "features")
    p = select.feature_profile(d, _FEATURES, "label")
    return _rounded(p, ["feature", "nulls"], ["mean", "std", "skew", "kurtosis", "target_corr", "median", "iqr", "outlier_share"], 2)


def constant_filter(spark, sf):
    d = _feature_table(spark, sf).withColumn("flat", F.lit(3.0))
    return spark.createDataFrame([(f,) for f in select.constant_features(d, [*_FEATURES, "flat"])], "feature string")


def corr_filter(spark, sf):
    d = _feature_table(spark, sf).withColumn("twin", F.col("close") * 2.0 + F.col("volume") * 1e-9)
    return spark.createDataFrame([(f,) for f in select.collinear_features(d, [*_FEATURES, "twin"])], "feature string")


def mutual_information(spark, sf):
    d = settle(_feature_table(spark, sf), "features")
    return select.mutual_information(d, _FEATURES, "label").select("feature", cut(F.col("mi"), 6).alias("mi"))


def autocorr_top(spark, sf):
    d = select.autocorrelation_top(shelf(spark, sf, "flag_daily"), pct(C), 99, 5)
    return d.select("symbol", "lag", F.col("place").cast("int").alias("place"), cut(F.col("corr"), 6).alias("corr"))


def ensemble_rank(spark, sf):
    d = settle(_feature_table(spark, sf), "features")
    mi = select.mutual_information(d, _FEATURES, "label").select(F.lit("mi").alias("method"), "feature", F.col("mi").alias("score"))
    corr = select.unpivot(d, _FEATURES, "label").groupBy("feature").agg(F.abs(F.corr("value", F.col("label").cast("double"))).alias("score")).select(F.lit("corr").alias("method"), "feature", "score")
    s = mi.unionByName(corr).withColumn("chosen", F.col("score") > F.when(F.col("method") == "mi", 0.001).otherwise(0.01))
    return select.ensemble_rank(s, 2).select("feature", cut(F.col("rank_score"), 5).alias("rank_score"))


def forest_stability(spark, sf):
    d = settle(_feature_table(spark, sf).withColumn("fold", prep.time_folds(3)), "features")
    return select.importance_stability(d, _FEATURES, "label", True, 3, 10)


# --- evaluation ----------------------------------------------------------------------------------
def _predictions(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = lambda i: 1.0 / (1.0 + F.exp(-F.col("embedding")[i].cast("double")))
    models = ["LSTM", "GRU", "Conv1D", "Conv1D_LSTM"]
    row = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.when(F.col("label") % 2 == 0, "buy").otherwise("sell").alias("side"), x(i).alias("probability"), F.lit(float(i + 1)).alias("weight"))
        for i, m in enumerate(models)]))
    return e.select(F.col("vec_id").alias("ts"), row.alias("r")).select("ts", "r.*")


def calibrate(spark, sf):
    p = _predictions(spark, sf)
    return p.select("ts", "model", "side", cut(evaluate.calibrate(F.col("probability")), 6).alias("calibrated"))


def vote_ensemble(spark, sf):
    v = evaluate.weighted_vote(_predictions(spark, sf))
    return v.select("ts", "side", "models", "signal", cut(F.col("vote"), 6).alias("vote"))


def threshold_signals(spark, sf):
    t = spark.createDataFrame(evaluate.THRESHOLDS, "model string, side string, threshold double")
    s = evaluate.model_summary(evaluate.threshold_signals(_predictions(spark, sf), t))
    return _rounded(s, ["model", "side", "n", "signals"], ["rate", "avg_probability", "min_probability", "max_probability"], 6)


def tiered_rule(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = lambda i: F.col("embedding")[i].cast("double")
    s = lambda i: 1.0 / (1.0 + F.exp(-4 * x(i)))
    d = e.select("vec_id", s(0).alias("buy_probability"), s(1).alias("sell_probability"), s(2).alias("direction_probability"),
                 x(3).alias("return_1"), x(4).alias("return_5"), x(5).alias("return_14"))
    return evaluate.tiered_rule(d).select("vec_id", "signal", cut(F.col("confidence"), 6).alias("confidence"))


def forecast_metrics(spark, sf):
    laid = shelf(spark, sf, "flag_daily")
    d = prep.sliding_windows(laid, ["close"], 5, 5).withColumn("guess", F.array_repeat(F.col("window")[4], 5))
    m = evaluate.forecast_metrics(d, "ahead", "guess")
    return _rounded(m, ["step", "n"], ["rmse", "mae", "r2"], 2)


def interval_forecast(spark, sf):
    d = add_features(shelf(spark, sf, "flag_daily"), {"guess": lag(C)}, ["symbol", "ts", "close"]).filter("guess is not null")
    out = evaluate.interval_forecast(d, "guess", "close")
    return _rounded(out.withColumn("ts", stamp()), ["symbol", "ts"], ["lower", "upper"], 2)


def direction_scores(spark, sf):
    laid = shelf(spark, sf, "flag_daily")
    d = Laid(laid.df.withColumn("guess", (F.col("open") + F.col("close")) / 2), laid.rows)
    a = evaluate.direction_accuracy(d, "close", "guess").join(evaluate.direction_aware_loss(d, "close", "guess"), "symbol")
    return _rounded(a, ["symbol"], ["direction_accuracy", "loss"], 6)


def asymmetric_loss(spark, sf):
    d = shelf(spark, sf, "flag_daily").df
    return evaluate.asymmetric_loss(d, "close", "open", 2.0).select(cut(F.col("loss"), 0).alias("loss"))


def class_balance(spark, sf):
    c = evaluate.class_balance(spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    return c.select("label", "n", cut(F.col("share"), 6).alias("share"))


def structure_report(spark, sf):
    r = evaluate.structure_report(_feature_table(spark, sf), "label", _FEATURES)
    return r.select("rows", "features", "nulls", "positives", cut(F.col("rate"), 6).alias("rate"))


# --- walk forward ---------------------------------------------------------------------------------
def _walk(laid, models, unit="quarter"):
    """Two sides of a five-bar change, from five features."""
    from tidebars.operators.walk_forward import walk_forward

    low, high = roll("min", C, 20), roll("max", C, 20)
    features = {
        "gap20": C / sma(C, 20) - 1.0, "change5": C / lag(C, 5) - 1.0, "change1": C / lag(C) - 1.0,
        "width": (H - L) / C, "place": when((high - low) > 0.0, (C - low) / (high - low)),
    }
    ahead = lead(C, 5) / C - 1.0
    side = lambda hit: when(true(hit), 1, true(ahead.eq(ahead)), 0)
    return walk_forward(laid, features, {"buy": side(ahead > 0.002), "sell": side(ahead < -0.002)}, models, 5, unit)


def _sum_models(kind):
    from tidebars.operators.walk_forward import Model

    names = {"trend": ("gap20", "change5", "place"), "swing": ("change1", "width")}
    return [Model(n, side, f, kind) for n, f in names.items() for side in ("buy", "sell")]


def walk_forward(spark, sf):
    d = _walk(shelf(spark, sf, "flag_daily"), _sum_models("bayes"))
    return _rounded(d.withColumn("ts", stamp()), ["symbol", "ts", "fold", "side", "model", "signal"], ["probability"])


def walk_forward_trades(spark, sf):
    from tidebars.operators.walk_forward import walk_ledger

    laid = shelf(spark, sf, "flag_daily")
    t = walk_ledger(laid, _walk(laid, _sum_models("bayes")), "buy", "sell", "trend")
    d = ledger.balance(t, 10000.0).select("symbol", "entry_ts", "balance").join(t, ["symbol", "entry_ts"], "right")
    return _rounded(d.select("symbol", "side", "entry_seq", F.col("exit_seq").cast("double").alias("exit_seq"), "pnl", "balance"), ["symbol", "side", "entry_seq", "exit_seq"], ["pnl", "balance"], 2)


def walk_forward_summary(spark, sf):
    """Ridge scores and a forest refitted every year, summed up by model and side."""
    from tidebars.operators.walk_forward import Model

    forest = [Model("forest", side, ("gap20", "change5", "change1", "width", "place"), "forest", 0.55) for side in ("buy", "sell")]
    return evaluate.model_summary(_walk(shelf(spark, sf, "flag_daily"), _sum_models("ridge") + forest, "year"))


# --- streaming ------------------------------------------------------------------------------------
def _event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(str(sf))
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_bars(spark, sf):
    """Hourly bars of the event stream; the close of the input is marked, and the windows still open come out of state."""
    from tidebars.streaming.bars import drained
    from tidebars.streaming.bars import stream_bars as build

    hourly = lambda s: build(s, F.col("event_type"), F.col("value"), F.lit(1.0), ["ts", "event_id"], "1 hour", "1 hour", "ts", ["event_id"])
    bars = drained(spark, _event_stream(spark, sf), hourly, "stream-bars")
    return _rounded(bars.withColumn("ts", stamp()), ["symbol", "ts"], list(B.PRICE_COLUMNS))


def _streamed_indicators(spark, sf):
    """Bars replayed in weekly files, two a batch."""
    from tidebars.streaming.bars import drained, replayed, state_in_rocksdb, stream_indicators

    bars = shelf(spark, sf, "events_hourly").df.select("symbol", "ts", *B.PRICE_COLUMNS)
    with state_in_rocksdb(spark):
        return drained(spark, replayed(bars, "week", "replay", 2), stream_indicators, "stream-indicators")


def stream_signals(spark, sf):
    """Incremental indicators and cooled-down signals over bars read as a stream."""
    d = _streamed_indicators(spark, sf)
    return _rounded(d.withColumn("ts", stamp()), ["symbol", "ts", "signal"], ["close", "sma", "ema_fast", "ema_slow", "rsi"])


def stream_context(spark, sf):
    """Range, volume and extremes of the rolling context, from the same stream."""
    d = _streamed_indicators(spark, sf)
    return _rounded(d.withColumn("ts", stamp()), ["symbol", "ts", "repeats"], ["atr", "obv", "vwap", "top", "bottom"])
