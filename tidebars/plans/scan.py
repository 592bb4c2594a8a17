"""Ordered folds that stay parallel over the chunks of one symbol.

``chunk_fold`` is for rules whose state is small but has no algebra to combine
(parabolic stop, cycle filters, cool-downs, greedy choices, average cost).
Every chunk first guesses its start state by running over the bars before it;
the guesses are then checked against the true end state of the chunk before,
and only chunks whose guess was wrong are run again, until all agree.  The
result is the sequential one; with states that forget their past, one or two
rounds suffice.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.plans.layout import Laid, settle, with_halo

_STATES = "symbol string, chunk long, start array<double>, end array<double>"


def _arrays(pdf: pd.DataFrame, columns: list[str]) -> dict[str, np.ndarray]:
    return {c: pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in columns}


def chunk_fold(
    laid: Laid, step: Callable, init: list[float], columns: list[str], outputs: list[str],
    keep: list[str] | None = None, warm: int = 512, tol: float = 0.0, max_rounds: int | None = None,
) -> DataFrame:
    """``step(state, columns) -> (state, outputs)`` over the bars of each symbol in order.

    ``tol`` is the relative difference up to which two states count as equal; 0
    for states made of positions and flags, small for decaying filters.
    """
    rows = laid.rows
    keep = list(keep or ["symbol", "ts", "seq"])
    cols = list(dict.fromkeys(columns + ["seq"]))
    slim = laid.df.select("symbol", "chunk", "bars", *cols)

    def guess(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", ignore_index=True)
        chunk = int(pdf["chunk"].iloc[0])
        own = pdf["seq"].to_numpy() >= chunk * rows
        state = list(init)
        if (~own).any():
            state, _ = step(state, _arrays(pdf[~own], cols))
        end, _ = step(list(state), _arrays(pdf[own], cols))
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "chunk": [chunk], "start": [list(map(float, state))], "end": [list(map(float, end))]})

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", ignore_index=True)
        state = list(pdf["want"].iloc[0])
        end, _ = step(list(state), _arrays(pdf, cols))
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "chunk": [int(pdf["chunk"].iloc[0])], "start": [state], "end": [list(map(float, end))]})

    states = settle(with_halo(Laid(slim, rows), warm).groupBy("symbol", "chunk").applyInPandas(guess, _STATES), "states")
    order = Window.partitionBy("symbol").orderBy("chunk")  # one row per chunk
    rounds = 0
    while True:
        chained = states.withColumn("want", F.lag("end").over(order)).filter("chunk > 0")
        off = F.exists(F.zip_with("want", "start", lambda a, b: F.abs(a - b) > tol * (F.lit(1.0) + F.abs(a))), lambda v: v)
        wrong = chained.filter(off | (F.size("want") != F.size("start"))).select("symbol", "chunk", "want")
        if wrong.isEmpty():
            break
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError("chunk states did not agree; raise max_rounds or chunk_rows")
        redone = slim.join(wrong, ["symbol", "chunk"]).groupBy("symbol", "chunk").applyInPandas(again, _STATES)
        new = redone.select("symbol", "chunk", F.col("start").alias("s2"), F.col("end").alias("e2"))
        states = settle(
            states.join(new, ["symbol", "chunk"], "left").select(
                "symbol", "chunk", F.coalesce("s2", "start").alias("start"), F.coalesce("e2", "end").alias("end")),
            "states",
        )

    wanted = list(dict.fromkeys(["symbol", "chunk", *keep, *cols]))
    full = laid.df.select(*wanted).join(states.select("symbol", "chunk", "start"), ["symbol", "chunk"])
    fields = [f for f in laid.df.select(*keep).schema.fields] + [T.StructField(o, T.DoubleType()) for o in outputs]

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", ignore_index=True)
        _, out = step(list(pdf["start"].iloc[0]), _arrays(pdf, cols))
        res = pdf[keep].copy()
        for o in outputs:
            res[o] = out[o]
        return res

    return full.groupBy("symbol", "chunk").applyInPandas(emit, T.StructType(fields))
