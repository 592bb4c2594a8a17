"""Mix of sources to target weights by weighted sampling without replacement (Efraimidis-Spirakis).

Each document gets an exponential key divided by its quality weight, so that
taking the smallest keys first samples by weight.  A source whose target holds
whole epochs takes all of its documents that often first; the rest of the target
is filled in key order, up to the document whose end lies nearest the budget.
The order is never sorted as a whole: keys fall into cells of about equal
counts, cell totals are summed up, and only the cell that holds the budget's end
is sorted.  One row per source is gathered on the driver, nothing else.

Null text has size 0 and weight of its own; a null source is a source, the last
one.  A source without words has target 0.  Equal rows have equal keys and are
taken together.  Reruns agree: keys are hashes of the row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm.textkit import WORD, row_key

SHARES = (3, 1, 2)
TOTAL = 1.5
MOST_EPOCHS = 2
ROWS_PER_CELL = 1000


@dataclass(frozen=True)
class Plan:
    """What a source takes: `epochs` times all of it, then keys up to (cell, key, row) of the last one."""

    source: str | None
    size: int
    target: float
    epochs: int
    mean_weight: float
    cells: int
    cell: int = -1
    key: float = -1.0
    row: int = 0


def quality_weight(text: Column) -> Column:
    """Share of letters and single spaces of a text, from 0.05 to 1: junk is drawn late."""
    letters = F.regexp_count(text, F.lit(r"[\p{L} ]"))
    return F.coalesce(F.lit(0.05) + F.lit(0.95) * F.pow(letters / F.greatest(F.char_length(text), F.lit(1)), 2), F.lit(0.05))


def targets(sizes: dict[str | None, int], shares: tuple[int, ...] = SHARES, total: float = TOTAL, most: float = MOST_EPOCHS) -> dict[str | None, float]:
    """Words each source shall give; what a full source cannot give is shared among the others."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: shares[i % len(shares)] for i, s in enumerate(names)}
    left, out, active = total * sum(sizes.values()), {}, set(names)
    while active:
        unit = left / sum(weight[s] for s in active)
        full = [s for s in names if s in active and unit * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in active}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
            active.discard(s)
    return out


def sized(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """df with its size, key and row name in columns of a struct `_mix`."""
    weight = quality_weight(F.col("text")) if weight is None else weight
    name = row_key()
    uniform = (F.pmod(F.xxhash64(name, F.lit("mix")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return df.withColumn(
        "_mix",
        F.struct(F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), (-F.log(uniform) / weight).alias("key"), name.alias("row"), weight.alias("weight")),
    )


def _plan_rows(df: DataFrame, plans: list[Plan]) -> DataFrame:
    schema = "name string, size bigint, target double, epochs int, mean_weight double, cells int, cell int, key double, row bigint"
    rows = df.sparkSession.createDataFrame([tuple(vars(p).values()) for p in plans], schema)
    return rows.select("name", F.struct(*rows.columns[1:]).alias("p"))


def _cell() -> Column:
    """Keys of a source in about equal cells, in their order."""
    return F.floor(F.col("p.cells") * (F.lit(1.0) - F.exp(-F.col("key") * F.col("p.mean_weight")))).cast("int")


def _with_plan(rows: DataFrame, plans: list[Plan]) -> DataFrame:
    return rows.join(_plan_rows(rows, plans), F.col("source").eqNullSafe(F.col("name")))


def plan(rows: DataFrame) -> list[Plan]:
    """rows: source, size, key, row, weight of all documents."""
    totals = {r.source: r for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.avg("weight").alias("weight"), F.count("*").alias("n")).collect()}
    goal = targets({s: r.size for s, r in totals.items()})
    plans = {s: Plan(s, r.size, goal[s], int(goal[s] // r.size) if r.size else 0, r.weight, max(1, math.ceil(r.n / ROWS_PER_CELL))) for s, r in totals.items()}
    budget = {s: p.target - p.epochs * p.size for s, p in plans.items()}
    if not plans:
        return []
    joined = _with_plan(rows.select("source", F.col("size").alias("words"), "key", "row"), [*plans.values()]).select("source", "words", "key", "row", _cell().alias("at"), (F.col("p.target") - F.col("p.epochs") * F.col("p.size")).alias("budget"))
    cells = joined.groupBy("source", "at", "budget").agg(F.sum("words").alias("words"))
    upto = Window.partitionBy("source").orderBy("at")
    ends = cells.withColumn("through", F.sum("words").over(upto)).filter("through >= budget").groupBy("source", "budget").agg(F.min(F.struct("at", "through", "words")).alias("end"))
    ends = ends.select("source", F.col("end.at").alias("at"), (F.col("end.through") - F.col("end.words")).alias("before"))
    last = ends.alias("e").join(joined.alias("j"), F.col("e.source").eqNullSafe(F.col("j.source")) & (F.col("e.at") == F.col("j.at"))).select("e.*", "j.words", "j.key", "j.row", "j.budget")
    order = Window.partitionBy("source").orderBy("key", "row")
    last = last.withColumn("through", F.col("before") + F.sum("words").over(order))
    # Of all places to stop, before the first document of the cell or after any, the nearest to the budget.
    near = last.groupBy("source", "at", "before", "budget").agg(F.min(F.struct(F.abs(F.col("through") - F.col("budget")).alias("off"), "key", "row")).alias("stop"))
    for r in near.collect():
        inside = r.stop.off < abs(r.before - r.budget)
        p = plans[r.source]
        plans[r.source] = Plan(p.source, p.size, p.target, p.epochs, p.mean_weight, p.cells, r["at"], r.stop.key if inside else -1.0, r.stop.row if inside else 0)
    return [p if budget[s] > 0 else Plan(*[*vars(p).values()][:6]) for s, p in plans.items()]


def taken_times(rows: DataFrame, plans: list[Plan]) -> DataFrame:
    """rows (with source, key, row and any other columns) and the plan of their source in p, with `times`."""
    at, key, row = _cell(), F.col("key"), F.col("row")
    chosen = (at < F.col("p.cell")) | ((at == F.col("p.cell")) & ((key < F.col("p.key")) | ((key == F.col("p.key")) & (row <= F.col("p.row")))))
    return _with_plan(rows, plans).withColumn("times", F.col("p.epochs") + F.when(F.col("p.cell") >= 0, chosen.cast("int")).otherwise(0))


def mix_report(df: DataFrame, folder: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row; sizes and keys are kept in `folder` while planning."""
    kept = sized(df.select("doc_id", "text", "source")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "_mix.*")
    kept.write.mode("overwrite").parquet(folder)
    rows = df.sparkSession.read.parquet(folder)
    plans = plan(rows)
    return taken_times(rows.withColumnRenamed("size", "words"), plans).select(
        "doc_id", F.col("words").alias("size"), F.col("p.size").alias("source_size"), F.col("p.target").alias("target"), (F.col("words") * F.col("times")).cast("bigint").alias("taken")
    )


def mixed(df: DataFrame, folder: str) -> DataFrame:
    """The rows of df that the mix takes, as often as it takes them, with df's columns."""
    # The row is packed first, so no column of df can clash with those of the mix.
    whole = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns))).alias("doc")
    all_rows = sized(df.select("doc_id", "text", "source", whole))
    all_rows.select("source", "_mix.*").write.mode("overwrite").parquet(folder)
    plans = plan(df.sparkSession.read.parquet(folder))
    packed = all_rows.select("source", "doc", F.col("_mix.key").alias("key"), F.col("_mix.row").alias("row"))
    taken = taken_times(packed, plans).filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return taken.select(*(F.col("doc").getField(f"c{i}").alias(c) for i, c in enumerate(df.columns)))
