"""Quality scores by kernel ridge regression on random Fourier features of document statistics.

Statistics of each whole text (shares of kinds of characters, words and repeats)
are standardized and mapped to cosines whose inner products approximate a
Gaussian kernel.  Every partition adds up its part of the normal equations of
the labelled rows; the sum (a matrix of fixed size) is solved on the driver.
Isotonic regression over fixed score bins turns ridge scores into probabilities.

Null or empty text has statistics of its own (all zero) and a score like any
other.  Without labelled rows, or with labels of one kind, every score is the
smoothed share of label 1.  Repeated rows give repeated results; a label that
occurs twice counts twice; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.textkit import Rolling, byte_values, flat_text, settle, slices, word_spans

FEATURES = 256
RIDGE = 1e-3
BINS = 2000
SEED = 11


def _kinds() -> np.ndarray:
    """Class of each byte: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 . and ,, 7 !, 8 *#$%&, 9 |, 10 other ASCII signs, 11 beyond ASCII."""
    kind = np.zeros(256, np.int64)
    for lo, hi, k in ((33, 127, 10), (97, 123, 1), (65, 91, 2), (48, 58, 3), (128, 256, 11)):
        kind[lo:hi] = k
    for letters, k in ((b" \t", 4), (b"\n\r\x0b\x0c", 5), (b".,", 6), (b"!", 7), (b"*#$%&", 8), (b"|", 9)):
        kind[list(letters)] = k
    return kind


KIND = _kinds()
N_KINDS = 12
STATS = 3 + N_KINDS + 10


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATS numbers for each text."""
    n_docs, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n_docs, STATS))
    if not len(raw):
        return out
    doc_of = np.repeat(np.arange(n_docs), sizes)
    kinds = np.bincount(doc_of * N_KINDS + KIND[raw], minlength=n_docs * N_KINDS).reshape(n_docs, N_KINDS)
    per_byte = 1.0 / np.maximum(sizes, 1)
    out[:, 0] = np.log1p(sizes)
    out[:, 3 : 3 + N_KINDS] = np.sqrt(kinds * per_byte[:, None])
    start, stop, first = word_spans(raw, offsets)
    words = np.diff(first)
    if not len(start):
        return out
    per_word, owner, length = 1.0 / np.maximum(words, 1), np.repeat(np.arange(n_docs), words), stop - start
    share = lambda flag: np.bincount(owner, weights=flag, minlength=n_docs) * per_word
    hashes = Rolling(byte_values(raw)).of(start, stop)
    out[:, 1] = np.log1p(words)
    mean = share(length)
    out[:, 2] = mean
    col = 3 + N_KINDS
    out[:, col] = np.sqrt(np.maximum(share(length.astype(float) ** 2) - mean**2, 0))
    last, head = KIND[raw[stop - 1]], KIND[raw[start]]
    out[:, col + 1] = share((last == 8) | (last == 9))
    out[:, col + 2] = share(last == 7)
    out[:, col + 3] = share(last == 6)
    out[:, col + 4] = share((head == 2) & (KIND[raw[np.minimum(start + 1, stop - 1)]] == 2) & (length > 1))
    for k, lag in enumerate((1, 2)):
        same = np.zeros(len(hashes), bool)
        same[lag:] = (hashes[lag:] == hashes[:-lag]) & (owner[lag:] == owner[:-lag])
        out[:, col + 5 + k] = share(same)
    order = np.lexsort((hashes, owner))
    fresh = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])]
    out[:, col + 7] = np.bincount(owner[order], weights=fresh, minlength=n_docs) * per_word
    run = np.diff(np.r_[np.flatnonzero(fresh), len(order)])
    most = np.zeros(n_docs)
    np.maximum.at(most, owner[order][fresh], run)
    out[:, col + 8] = most * per_word
    digits = np.zeros(n_docs)
    np.maximum.at(digits, owner, np.minimum(length, 60))
    out[:, col + 9] = digits
    return out


def document_statistics(df: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id and x array<double> for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = statistics(*flat_text(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * STATS, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "x"])

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id bigint, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), STATS)


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    edges: np.ndarray  # isotonic steps: scores from edges[i] on have levels[i]
    levels: np.ndarray

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -5, 5)
        return np.hstack([np.ones((len(x), 1)), np.cos(z @ self.omega + self.phase) * np.sqrt(2.0 / len(self.phase))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return calibrated(self.ridge(x), self.edges, self.levels)


def calibrated(raw: np.ndarray, edges: np.ndarray, levels: np.ndarray) -> np.ndarray:
    if not len(edges):
        return np.full(len(raw), levels[0])
    return np.interp(raw, edges, levels)


def isotonic(centers: np.ndarray, counts: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ordered bins: knots and non-decreasing levels (smoothed to stay inside 0 and 1)."""
    blocks: list[list[float]] = []
    for c, n, k in zip(centers, counts, ones):
        blocks.append([c * n, n, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    rate = ones.sum() / max(counts.sum(), 1)
    levels = np.array([(k + rate) / (n + 1) for _, n, k in blocks])
    return np.array([s / n for s, n, _ in blocks]), np.maximum.accumulate(levels)


def fit(rows: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> Model:
    """rows: x array<double>, y int (0 or 1)."""
    known = rows.filter("y is not null").select("x", F.col("y").cast("double").alias("y"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, STATS))
        n = k = 0.0
        for b in batches:
            x = _matrix(b.column("x"))
            total += np.vstack([x.sum(axis=0), (x**2).sum(axis=0)])
            n, k = n + len(x), k + b.column("y").to_numpy().sum()
        yield pa.RecordBatch.from_arrays([pa.array([np.r_[total.ravel(), n, k].tobytes()], pa.binary())], ["part"])

    sums = _added(known.mapInArrow(moments, "part binary"), 2 * STATS + 2)
    n, k = sums[-2:]
    empty = np.zeros(0)
    if n == 0 or k in (0, n):
        return Model(empty, empty, empty, empty, empty, empty, np.array([(k + 0.5) / (n + 1)]))
    center = sums[:STATS] / n
    scale = np.sqrt(np.maximum(sums[STATS : 2 * STATS] / n - center**2, 1e-9))
    rnd = np.random.default_rng(SEED)
    omega = rnd.normal(size=(STATS, features)) / np.sqrt(STATS)
    model = Model(center, scale, omega, rnd.uniform(0, 2 * np.pi, features), empty, empty, empty)
    wide = features + 1

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide, wide + 1))
        for b in batches:
            z = model.map(_matrix(b.column("x")))
            # Both labels weigh alike, however rare one is.
            y = b.column("y").to_numpy()
            w = np.where(y > 0, 0.5 / k, 0.5 / (n - k))
            total += np.hstack([z.T @ (z * w[:, None]), (z.T @ (w * y))[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    sums = _added(known.mapInArrow(normal, "part binary"), wide * (wide + 1)).reshape(wide, wide + 1)
    model.beta = np.linalg.solve(sums[:, :wide] + ridge * np.diag(np.r_[0, np.ones(features)]), sums[:, wide])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, BINS))
        for b in batches:
            raw, y = model.ridge(_matrix(b.column("x"))), b.column("y").to_numpy()
            at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            for row, w in enumerate((np.ones(len(y)), y, raw)):
                total[row] += np.bincount(at, weights=w, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    counts, ones, raw = _added(known.mapInArrow(binned, "part binary"), 3 * BINS).reshape(3, BINS)
    full = counts > 0
    model.edges, model.levels = isotonic(raw[full] / counts[full], counts[full], ones[full])
    return model


def _added(parts: DataFrame, size: int, fan: int = 32) -> np.ndarray:
    """Sum of blobs of `size` doubles: by groups of tasks first, then the few sums on the driver."""

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"part": pa.array([np.sum([np.frombuffer(p) for p in table.column("part").to_pylist()], axis=0).tobytes()], pa.binary())})

    grouped = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(fan))).groupBy("g").applyInArrow(add, "part binary")
    return np.sum([np.zeros(size), *(np.frombuffer(r.part) for r in grouped.collect())], axis=0)


def apply_model(rows: DataFrame, model: Model, keep: str) -> DataFrame:
    """`keep` (a bigint column), score of rows with x."""
    empty = not len(model.beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.full(b.num_rows, model.levels[0]) if empty else model.score(_matrix(b.column("x")))
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array(scores)], [keep, "score"])

    return rows.select(keep, "x").mapInArrow(run, f"{keep} bigint, score double")


def score_documents(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> tuple[DataFrame, Model]:
    """doc_id, score of every document; `learn` says (from doc_id) which labels may be used."""
    stats = settle(document_statistics(docs), "stats")
    known = labels.filter(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).alias("y"))
    model = fit(stats.join(known, "doc_id").select("x", "y"))
    return apply_model(stats, model, "doc_id"), model
