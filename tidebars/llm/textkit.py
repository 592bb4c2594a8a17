"""Helpers shared by the text operators: Arrow texts as flat bytes, words, hashes, bounded slices."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.plans.layout import forget

#: A word is a run of characters other than these bytes.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = []
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library, without malloc_trim
    _LIBC = None


def flat_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and len + 1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = SLICE_BYTES) -> Iterator:
    """The rows of a batch in runs of about `limit` bytes of text (one long text may exceed it)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) if batch.num_rows else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, and keep what they once held otherwise."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > SLICE_BYTES + 1:  # one long text; not worth keeping
        return _power(_ODD, n), _power(_INVERSE, n)
    if not _POWERS:
        _POWERS[:] = [_power(x, SLICE_BYTES + 1) for x in (_ODD, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _power(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes of any piece of a byte array, from one pass of prefix sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _VALUE[raw]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop byte of every word, and for each text the number of its first word (len + 1)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[raw]
    sizes = np.diff(offsets)
    begins = offsets[:-1][sizes > 0]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[begins] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[offsets[1:][sizes > 0] - 1] = False
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (sizes[i] of them) for every i, in one array."""
    total = int(sizes.sum())
    firsts = np.cumsum(sizes) - sizes
    return np.repeat(starts - firsts, sizes) + np.arange(total)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` consecutive values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def row_key() -> Column:
    """Names a row of documents by id and text; only equal rows share it."""
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark, name: str) -> str:
    """A new folder for tables that are written and read again, in spark.checkpoint.dir; deleted when the driver ends.

    The setting is only made here where it is unset (tests, local runs)."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidebars-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    forget(spark, folder)
    return folder


def settle(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and is computed once.

    Rows reach Python in batches of at most `batch` bytes, where given: a task holds several copies of a batch, in Java and in Python."""
    folder = shared_folder(df.sparkSession, name)
    with small_batches(df.sparkSession, batch):
        df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


@contextmanager
def small_batches(spark, size: int | None) -> Iterator[None]:
    """What runs meanwhile sends Python at most `size` bytes at a time; the session gets its setting back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key)
    if size is None:
        yield
        return
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, own)
