"""Feature preparation: quantiles, ranks, cleaning, encoding, scaling, windows, time splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.expr import C, Expr, coalesce, col, lag, ncol, when
from tidebars.plans.features import add_features
from tidebars.plans.layout import Laid, own_rows, settle, with_halo


# --- exact quantiles and ranks without a single-task sort ------------------------------
def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], accuracy: int = 20000, width: float = 3.0) -> DataFrame:
    """Interpolated quantiles of whole columns: rows (feature, p, value).

    A sketch with a known rank error brackets each wanted value; one map-side
    sum counts the rows below the bracket, and only the few rows inside it are
    ranked, as value counts, so ties weigh nothing.  A value that still falls
    outside (a sketch worse than its bound) is looked for again with a bracket
    eight times as wide, at last all rows.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = df.select(pairs.alias("x")).select("x.*").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    e = width / accuracy
    edges = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-e, e)]
    sk = long.groupBy("feature").agg(F.percentile_approx("v", F.array(*[F.lit(x) for x in edges]), accuracy).alias("q"))
    spans = F.array(*[
        F.struct(F.lit(float(p)).alias("p"), F.col("q")[2 * i].alias("lo"), F.col("q")[2 * i + 1].alias("hi")) for i, p in enumerate(probs)
    ])
    spans = settle(sk.select("feature", F.explode(spans).alias("s")).select("feature", "s.*"), "spans")
    placed = long.join(F.broadcast(spans), "feature")  # one row per column name and probability
    total = placed.groupBy("feature", "p").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("v") < F.col("lo")).cast("long")).alias("below"))
    near = placed.filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).groupBy("feature", "p", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("feature", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = near.join(F.broadcast(total), ["feature", "p"]).select(
        "feature", "p", "v", "c", (F.col("below") + F.sum("c").over(upto)).alias("upto"), ((F.col("n") - 1) * F.col("p")).alias("pos"))
    at = lambda r: F.max(F.when((r < F.col("upto")) & (r >= F.col("upto") - F.col("c")), F.col("v")))
    got = ranked.groupBy("feature", "p").agg(at(F.floor("pos")).alias("a"), at(F.ceil("pos")).alias("b"), F.max(F.col("pos") - F.floor("pos")).alias("w"))
    got = settle(got.select("feature", "p", (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("value")), "quantiles")
    wanted = sk.select("feature", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
    lost = wanted.join(got.filter("value is not null"), ["feature", "p"], "left_anti")
    return exact_quantiles(df, columns, probs, accuracy, width * 8) if e < 1.0 and not lost.isEmpty() else got


def quantile_row(df: DataFrame, columns: list[str], probs: list[float]) -> dict:
    """The same as {(feature, p): value}; a handful of numbers."""
    got = {(r["feature"], r["p"]): r["value"] for r in exact_quantiles(df, columns, probs).collect()}
    if any(v is None for v in got.values()):
        raise RuntimeError("a quantile fell outside its bracket; raise the accuracy")
    return got


def percent_rank_ties(df: DataFrame, column: str, out: str) -> DataFrame:
    """Average rank divided by count.  Values are counted, range-partitioned, and
    ranked per partition with the totals of the partitions before."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    n = settle(n.repartitionByRange(parts, column).withColumn("_pid", F.spark_partition_id()), "ranks")
    tot = n.groupBy("_pid").agg(F.sum("_n").alias("_t"))  # one row per partition
    tot = tot.select("_pid", F.coalesce(F.sum("_t").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
                     F.sum("_t").over(Window.partitionBy()).alias("_all"))
    w = Window.partitionBy("_pid").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    ranked = n.join(tot, "_pid").select(
        column, ((F.col("_start") + F.sum("_n").over(w) - (F.col("_n") - 1) / 2.0) / F.col("_all")).alias(out))
    return df.join(ranked, column, "left")


# --- cleaning ---------------------------------------------------------------------------
def finite(c: Column) -> Column:
    """Infinity and NaN become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(c, F.lit(float(hi))), F.lit(float(lo)))


def head_rows(laid: Laid, n: int = 10000, skip: int = 200) -> DataFrame:
    """Rows ``skip .. n`` of each symbol, by position."""
    return laid.df.filter((F.col("seq") >= skip) & (F.col("seq") < n))


def duplicate_columns(df: DataFrame, columns: list[str], keys: list[str]) -> list[str]:
    """Columns equal to an earlier one: compared by a hash total, then verified."""
    sums = df.agg(*[F.sum(F.xxhash64(*keys, F.col(c).cast("string")).cast("decimal(38,0)")).alias(c) for c in columns]).first()
    groups: dict = {}
    for c in columns:
        groups.setdefault(sums[c], []).append(c)
    pairs = [(g[0], c) for g in groups.values() for c in g[1:]]
    if not pairs:
        return []
    diff = df.agg(*[F.sum((~F.col(a).eqNullSafe(F.col(b))).cast("long")).alias(b) for a, b in pairs]).first()
    return [b for _, b in pairs if diff[b] == 0]


def label_encode(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Trimmed lower-case text to 0..k-1 in sorted order; null counts as '0'."""
    out = out or column
    v = F.coalesce(F.lower(F.trim(F.col(column))), F.lit("0"))
    d = df.withColumn("_v", v)
    codes = d.select("_v").distinct().select("_v", (F.dense_rank().over(Window.orderBy("_v")) - 1).cast("int").alias("_code"))
    return d.join(codes, "_v").drop("_v").withColumn(out, F.col("_code")).drop("_code")


def skew_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the median where |skew| > 1, else the mean."""
    st = df.agg(*[F.skewness(c).alias(f"s_{c}") for c in columns], *[F.avg(c).alias(f"m_{c}") for c in columns]).first()
    skewed = [c for c in columns if abs(st[f"s_{c}"] or 0) > 1]
    med = quantile_row(df, skewed, [0.5]) if skewed else {}
    return df.na.fill({c: med[(c, 0.5)] if c in skewed else st[f"m_{c}"] for c in columns})


def median_fill(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Selection input: infinities become null, nulls the median; rows without target go."""
    d = df.select(*[c for c in df.columns if c not in columns], *[finite(F.col(c).cast("double")).alias(c) for c in columns])
    med = quantile_row(d, columns, [0.5])
    return d.na.fill({c: med[(c, 0.5)] for c in columns if (c, 0.5) in med}).na.drop(subset=[target])


# --- features -----------------------------------------------------------------------------
# fixed values: lags of the supervised table, and of the two scoring sides
LAGS = {"train": [1, 2, 3, 5, 10], "buy": [61, 93, 64, 60, 77], "sell": [70, 24, 10, 74, 39]}


def lag_matrix(columns: dict[str, Expr], target: str, lags=None) -> dict[str, Expr]:
    """Every column at every lag, plus mean and sample deviation of those lags of the target that exist."""
    lags = list(lags or LAGS["train"])
    out = {f"{n}_lag_{k}": lag(x, k) for n, x in columns.items() for k in lags}
    ts = [lag(columns[target], k) for k in lags]
    from tidebars.functions.expr import fill0, isnull, sqrtx

    there = [when(isnull(t), 0.0, otherwise=1.0) for t in ts]
    n = sum(there[1:], start=there[0])
    mean = sum((fill0(t) for t in ts[1:]), start=fill0(ts[0])) / n
    off = [fill0((t - mean) * (t - mean)) for t in ts]
    out[f"{target}_lag_mean"] = mean
    out[f"{target}_lag_std"] = when(n > 1.0, sqrtx(sum(off[1:], start=off[0]) / (n - 1.0)), otherwise=None)
    return out


def volume_transforms(df: DataFrame, column: str = "volume") -> DataFrame:
    """log1p, 1-99 % winsor bounds and percent rank."""
    q = quantile_row(df, [column], [0.01, 0.99])
    d = df.withColumn(f"{column}_log", F.log1p(column)).withColumn(
        f"{column}_winsor", clip(F.col(column), q[(column, 0.01)], q[(column, 0.99)]))
    return percent_rank_ties(d, column, f"{column}_rank")


def robust_scale(df: DataFrame, columns: list[str], train: Column, low=0.1, high=0.9, bound=10.0) -> DataFrame:
    """(x - median) / (q_high - q_low), clipped; fitted on the training rows only."""
    q = quantile_row(df.filter(train), columns, [0.5, low, high])
    out = []
    for c in columns:
        width = q[(c, high)] - q[(c, low)] or 1.0
        out.append(clip((F.col(c) - q[(c, 0.5)]) / width, -bound, bound).alias(c))
    return df.select(*[c for c in df.columns if c not in columns], *out)


def sliding_windows(laid: Laid, columns: list[str], n_in: int, n_out: int = 0, target: str = "close") -> DataFrame:
    """The last ``n_in`` rows of every bar as one flat array (row by row), and the
    next ``n_out`` targets; only full windows."""
    d = with_halo(laid, n_in - 1, n_out)
    w = Window.partitionBy("symbol", "chunk").orderBy("seq")
    row = F.array(*[F.col(c).cast("float") for c in columns])
    out = d.select(
        "symbol", "ts", "seq", "chunk", "bars", F.flatten(F.collect_list(row).over(w.rowsBetween(-(n_in - 1), 0))).alias("window"),
        *([F.collect_list(F.col(target).cast("float")).over(w.rowsBetween(1, n_out)).alias("ahead")] if n_out else []),
    )
    out = own_rows(out, laid.rows).filter((F.col("seq") >= n_in - 1) & (F.col("seq") < F.col("bars") - n_out))
    return out.drop("chunk", "bars")


def clean_windows(df: DataFrame, bound: float = 10.0) -> DataFrame:
    """Null to 0, infinities to the bound, everything clipped."""
    z = lambda v: F.greatest(F.least(F.coalesce(F.nanvl(v, F.lit(0.0).cast("float")), F.lit(0.0).cast("float")), F.lit(bound).cast("float")), F.lit(-bound).cast("float"))
    return df.withColumn("window", F.transform("window", z))


def stratified_sample(df: DataFrame, label: str, at_most: int, seed: int = 42) -> DataFrame:
    """About ``at_most`` rows with the class shares kept."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    share = min(1.0, at_most / max(1, sum(counts.values())))
    return df.sampleBy(label, {k: share for k in counts}, seed)


# --- time splits by position ------------------------------------------------------------------
def chronological_split(train_share: float = 0.8) -> Column:
    """True on the first share of each symbol's bars."""
    return F.col("seq") < F.floor(F.col("bars") * train_share)


def time_folds(k: int = 5) -> Column:
    """Test fold 0..k-1 of expanding splits; -1 for bars that only ever train."""
    size = F.floor(F.col("bars") / (k + 1))
    f = (k - 1 - F.floor((F.col("bars") - 1 - F.col("seq")) / size)).cast("int")
    return F.greatest(f, F.lit(-1))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight column n / (classes * n_class)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    t = c.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    w = c.crossJoin(F.broadcast(t)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))  # one row
    return df.join(F.broadcast(w), label)  # one row per class
