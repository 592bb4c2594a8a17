"""Fourier spectrum of a whole symbol, however long, by a four-step transform over groups.

A series of any length n is transformed at its own n frequencies by a chirp: with
jk = (j^2 + k^2 - (k - j)^2) / 2 the transform is a convolution with a chirp, done at
a length M = N1 * N2, a power of two that holds it.  A transform of length M takes the
matrix of N1 x N2 values column by column, turns each value by its twiddle, and takes
the result row by row; going back runs over the same rows and ends in columns.  So the
series is exchanged three times: into columns, into rows, and back into columns.  A
group holds at most `cells` values and no task more than one group at a time.

Phases are reduced as whole numbers before they become angles, so that long series lose nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """How a series of `bars` values lies in a matrix of tall x wide cells, cut into `groups` of columns or of rows."""

    bars: int
    tall: int
    wide: int
    groups: int

    @staticmethod
    def of(bars: int, cells: int) -> Grid:
        power = max(2, (2 * bars - 2).bit_length())
        tall, wide = 1 << (power + 1) // 2, 1 << power // 2
        return Grid(bars, tall, wide, min(wide, max(1, 1 << max(0, power - max(1, cells).bit_length() + 1))))

    @property
    def columns(self) -> int:
        return self.wide // self.groups

    @property
    def rows(self) -> int:
        return self.tall // self.groups

    def turn(self, steps: np.ndarray, whole: int) -> np.ndarray:
        return np.exp(-2j * np.pi * (steps % whole) / whole)

    def chirp(self, at: np.ndarray) -> np.ndarray:
        return self.turn(at * at, 2 * self.bars)

    def twiddle(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return self.turn(rows[:, None] * columns[None, :], self.tall * self.wide)

    def column_numbers(self, group: int) -> np.ndarray:
        return group * self.columns + np.arange(self.columns)

    def row_numbers(self, group: int) -> np.ndarray:
        return group * self.rows + np.arange(self.rows)


def column_group(seq: Column, bars: Column, cells: int) -> Column:
    """The group of columns of place `seq`, as Grid cuts them (power: bit length of 2 * bars - 2)."""
    power = F.greatest(F.lit(2), F.length(F.bin(2 * bars - 2)))
    wide = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.floor(power / 2).cast("int"))
    spare = F.greatest(F.lit(0), power - (max(1, cells).bit_length() - 1)).cast("int")
    groups = F.least(wide, F.call_function("shiftleft", F.lit(1).cast("bigint"), spare))
    return F.floor((seq % wide) / (wide / groups)).cast("bigint")


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.complex128).tobytes()


def _sent(symbol, bars: int, at: int, parts: list[np.ndarray]) -> pa.Table:
    n = len(parts)
    return pa.table({"symbol": pa.array([symbol] * n), "bars": pa.array([bars] * n, pa.int64()), "to": pa.array(range(n), pa.int64()), "at": pa.array([at] * n, pa.int64()), "part": pa.array([_blob(p) for p in parts], pa.binary())})


def power_spectrum(series: DataFrame, cells: int) -> DataFrame:
    """symbol, bars, group, k and power of the strongest bin 1 .. bars / 2 of each group of series(symbol, seq, bars, x).

    Among equal powers the least k is taken.  Places without a value count as 0; a series of one value has no bin."""
    kind = series.schema["symbol"].dataType.simpleString()
    swapped = f"symbol {kind}, bars bigint, to bigint, at bigint, part binary"

    def into_columns(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        symbol, bars, group = (k.as_py() for k in key)
        grid = Grid.of(bars, cells)
        seq = table.column("seq").to_numpy()
        both = np.zeros((2, grid.tall, grid.columns), np.complex128)
        columns, rows = grid.column_numbers(group), np.arange(grid.tall)
        both[0, seq // grid.wide, seq % grid.wide - columns[0]] = np.nan_to_num(table.column("x").to_numpy()) * grid.chirp(seq)
        # The chirp to convolve with is symmetric: place p stands for p and for p - M.
        place = rows[:, None] * grid.wide + columns[None, :]
        place = np.minimum(place, grid.tall * grid.wide - place)
        both[1] = np.where(place < bars, np.conj(grid.chirp(np.minimum(place, bars))), 0)
        both = np.fft.fft(both, axis=1) * grid.twiddle(rows, columns)
        return _sent(symbol, bars, group, [both[:, g * grid.rows : (g + 1) * grid.rows] for g in range(grid.groups)])

    def gathered(table: pa.Table, shape: tuple[int, ...]) -> np.ndarray:
        table = table.sort_by("at")
        return np.concatenate([np.frombuffer(b.as_py(), np.complex128).reshape(shape) for b in table.column("part")], axis=-1 if len(shape) == 3 else 0)

    def over_rows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        symbol, bars, group = (k.as_py() for k in key)
        grid = Grid.of(bars, cells)
        both = np.fft.fft(gathered(table, (2, grid.rows, grid.columns)), axis=2)
        back = np.fft.ifft(both[0] * both[1], axis=1)
        back *= np.conj(grid.twiddle(grid.row_numbers(group), np.arange(grid.wide)))
        return _sent(symbol, bars, group, [back[:, g * grid.columns : (g + 1) * grid.columns] for g in range(grid.groups)])

    def back_in_columns(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        symbol, bars, group = (k.as_py() for k in key)
        grid = Grid.of(bars, cells)
        value = np.fft.ifft(gathered(table, (grid.rows, grid.columns)), axis=0)
        k = np.arange(grid.tall)[:, None] * grid.wide + grid.column_numbers(group)[None, :]
        mine = (k >= 1) & (k <= bars // 2)
        k, power = k[mine], np.abs(value[mine]) ** 2
        best = np.lexsort((k, -power))[:1]
        n = len(best)
        return pa.table({"symbol": pa.array([symbol] * n, table.schema.field("symbol").type), "bars": pa.array([bars] * n, pa.int64()), "group": pa.array([group] * n, pa.int64()), "k": pa.array(k[best], pa.int64()), "power": pa.array(power[best], pa.float64())})

    x = series.filter("bars > 1").select("symbol", F.col("bars").cast("bigint").alias("bars"), "seq", "x")
    x = x.withColumn("group", column_group(F.col("seq"), F.col("bars"), cells))
    # A group of columns without any value would still hold part of the chirp; each has one, as bars >= wide.
    columns = x.groupBy("symbol", "bars", "group").applyInArrow(into_columns, swapped)
    rows = columns.groupBy("symbol", "bars", "to").applyInArrow(over_rows, swapped)
    return rows.groupBy("symbol", "bars", "to").applyInArrow(back_in_columns, f"symbol {kind}, bars bigint, group bigint, k bigint, power double")
