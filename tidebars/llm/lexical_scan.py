"""Ranked lexical search by scanning the documents with an automaton of the items' terms.

Every byte that belongs to no term becomes a guard, A-Z become a-z, and the terms
stand in the automaton between two guards, so a match is a whole term.  One scan
of all texts gives each document's length and the frequencies of the items' terms;
there is no index of the documents.  The counts are stored, the statistics of the
corpus are added up from them, and a second pass over the counts maps terms to
items, scores in 64-bit integers and keeps the best of each item per task.

Items are rows and each is ranked by itself.  They are taken in blocks of at most
BLOCK_BYTES of text, one automaton and one scan for each block, so what is broadcast
is bounded.  Null and empty texts have no terms and are not counted.  Documents are
rows: repeated rows are ranked one after another.  A null doc_id comes last among
equal scores.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm.textkit import flat_text, settle, slices, spread

BEST = 20
#: Text of the items that one automaton holds; more items mean more scans.
BLOCK_BYTES = 4 << 20
#: Scores held at once by a task.
CELLS = 1 << 21
GUARD = 0x20
NO_DOC = np.iinfo(np.int64).max


def _guarded() -> np.ndarray:
    """For each byte what the automaton reads: a guard for what is in no term, lower case for A-Z."""
    out = np.full(256, GUARD, np.uint8)
    for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        out[a : b + 1] = np.arange(a, b + 1)
    out[0x41:0x5B] += 32
    return out


READ = _guarded()


def guarded(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as the automaton reads them, with a guard before, between and after; text i begins after place[i]."""
    raw, offsets = flat_text(column)
    return np.insert(READ[raw], offsets, GUARD), offsets + np.arange(len(offsets))


def sizes_of(read: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Number of terms of each text."""
    inside = read != GUARD
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    return np.diff(np.searchsorted(starts, place))


@dataclass
class Items:
    """A block of items: their terms by number, and for each term the items that hold it."""

    terms: list[bytes] = field(default_factory=list)
    start: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @staticmethod
    def of(texts: pa.ChunkedArray) -> Items:
        read, place = guarded(texts)
        held: dict[bytes, dict[int, int]] = {}
        data = read.tobytes()
        for i, (a, b) in enumerate(zip(place[:-1], place[1:])):
            for term in data[a:b].split():
                of = held.setdefault(term, {})
                of[i] = of.get(i, 0) + 1
        terms = sorted(held)
        pairs = [p for t in terms for p in held[t].items()]
        return Items(terms, np.cumsum([0, *(len(held[t]) for t in terms)]), np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64))

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(self.terms):
            out.add_word(f" {term.decode('latin-1')} ", i)
        if self.terms:
            out.make_automaton()
        return out


def scan(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n, terms, tf of every document with a term: its length and the items' terms in it (stored)."""
    shared = docs.sparkSession.sparkContext.broadcast(items.automaton())  # bounded by BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        size = max(1, len(automaton))
        for batch in batches:
            for part in slices(batch):
                read, place = guarded(part.column("text"))
                n = sizes_of(read, place)
                found = np.fromiter((x for m in automaton.iter(read.tobytes().decode("latin-1")) for x in m), np.int64).reshape(-1, 2) if len(automaton) else np.zeros((0, 2), np.int64)
                # A match ends on the guard after its term.
                keys, tf = np.unique((np.searchsorted(place, found[:, 0] - 1, "right") - 1) * size + found[:, 1], return_counts=True)
                cuts = np.searchsorted(keys // size, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v)) for v in ((keys % size).astype(np.int32), tf.astype(np.int64))]
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])
                yield out.filter(pa.array(n > 0))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return settle(rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tf array<bigint>"), "counts")


def weights(df: np.ndarray, total: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k best of their item."""
    order = np.lexsort((doc, -score, item))
    first = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - first < k]


def rank_block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id, score for a block of items that fits the driver."""
    spark = docs.sparkSession
    held = block.toArrow()  # at most BLOCK_BYTES of text, see rank
    ids = held.column("item_id").combine_chunks()
    items = Items.of(held.column("text"))
    counts = scan(docs, items)
    total, length = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = counts.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # one row for each term of the block
    df = np.zeros(len(items.terms), np.int64)
    df[found.column("term").to_numpy()] = found.column("count").to_numpy()
    shared = spark.sparkContext.broadcast((items, weights(df, total), held.num_rows))  # bounded by BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, width = shared.value
        best = [np.zeros(0, np.int64) for _ in range(3)]
        least = np.ones(width, np.int64)
        step = max(1, CELLS // max(1, width))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                doc = part.column("doc_id").fill_null(NO_DOC).to_numpy(zero_copy_only=False)
                m = 75 + 25 * part.column("n").to_numpy() * total // max(1, length)
                terms, tf = part.column("terms").flatten().to_numpy(), part.column("tf").flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), part.column("terms").value_lengths().to_numpy())
                value = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))
                scores = np.zeros(part.num_rows * width, np.int64)
                many = items.start[terms + 1] - items.start[terms]
                ends = np.cumsum(many)
                a = 0
                while a < len(terms):
                    b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS, "right")))
                    to = spread(items.start[terms[a:b]], many[a:b])
                    np.add.at(scores, np.repeat(row[a:b] * width, many[a:b]) + items.item[to], np.repeat(value[a:b], many[a:b]) * items.times[to])
                    a = b
                d, i = np.nonzero(scores.reshape(part.num_rows, width) >= least)
                best = [np.r_[old, new] for old, new in zip(best, (i, scores[d * width + i], doc[d]))]
                best = [x[y] for y in [_best(*best, k)] for x in best]
                # Only what reaches the k-th best of its item can still come in.
                filled = np.bincount(best[0], minlength=width) == k
                low = np.full(width, np.iinfo(np.int64).max)
                np.minimum.at(low, best[0], best[1])
                least = np.where(filled, np.maximum(low, 1), 1)
        out = pa.array(best[2], mask=best[2] == NO_DOC)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(best[0])), pa.array(best[0]), out, pa.array(best[1])], ["item_id", "item", "doc_id", "score"])

    kind = block.schema["item_id"].dataType.simpleString()
    some = counts.mapInArrow(run, f"item_id {kind}, item bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, benchmark: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    if blocks == 1:
        return rank_block(docs, items, k)
    # Twice as many as needed, so that a block stays near its size.
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * blocks))
    parts = [settle(rank_block(docs, items.filter(of == b), k), "ranked") for b in range(2 * blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
