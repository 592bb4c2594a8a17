"""Repeated passages found by content-chosen anchors; shared by the two substring operators.

A window (13 words, 200 bytes) holds several k-grams; the least hash among them
is the window's anchor, so equal windows have equal anchors at equal places.
1. Every bucket of documents reports the hashes of its anchors; a hash reported
   twice is repeated, and goes back to the buckets that have it.
2. For a repeated anchor, the stretch of text of all windows it stands for goes
   to the task that owns the anchor.  Equal stretches of a bucket travel once,
   with the places where they stand.
3. The owner decides (suffix tree, suffix array) which windows repeat and
   answers with ranges to remove, by bucket.
4. Each bucket applies the answers to its documents.
All four read one exchange of the documents by bucket.  An anchor with very many
places (`hot`) is not sent as a whole: each of its windows goes by its own hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.textkit import Rolling, byte_values, flat_text, row_key, shuffle_partitions, slices, sliding_least, word_spans

LOW = np.uint64(0xFFFFFFFF)
HOT_PLACES = 20_000
DOCS_PER_BUCKET = 800


@dataclass
class Units:
    """The units (words or bytes) of a slice of documents."""

    raw: np.ndarray
    first: np.ndarray  # first unit of each document, and one past the last
    start: np.ndarray  # bytes of each unit
    stop: np.ndarray
    hashes: Rolling


@dataclass
class Runs:
    """Consecutive windows with one anchor: windows lo..hi, anchor at `at` (unit numbers in the slice)."""

    lo: np.ndarray
    hi: np.ndarray
    at: np.ndarray
    seed: np.ndarray
    doc: np.ndarray


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Units:
    start, stop, first = word_spans(raw, offsets)
    return Units(raw, first, start, stop, Rolling(Rolling(byte_values(raw)).of(start, stop)))


def bytes_of(raw: np.ndarray, offsets: np.ndarray) -> Units:
    place = np.arange(len(raw), dtype=np.int64)
    return Units(raw, offsets, place, place + 1, Rolling(byte_values(raw)))


def runs_of(units: Units, window: int, gram: int) -> Runs:
    n = len(units.start)
    none = np.zeros(0, np.int64)
    if n < window:
        return Runs(none, none, none, none.astype(np.uint64), none)
    place = np.arange(n - gram + 1, dtype=np.int64)
    seeds = units.hashes.of(place, place + gram)
    least = sliding_least((seeds & ~LOW) | place.astype(np.uint64), window - gram + 1)
    counts = np.maximum(np.diff(units.first) - window + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    firsts = np.cumsum(counts) - counts
    starts = np.arange(int(counts.sum())) - firsts[doc] + units.first[:-1][doc]
    anchor = (least[starts] & LOW).astype(np.int64)
    change = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else none
    last = np.r_[change[1:], len(anchor)] - 1 if len(change) else none
    return Runs(starts[change], starts[last], anchor[change], seeds[anchor[change]], doc[change])


def _blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _parts_of(seed: np.ndarray, parts: int) -> np.ndarray:
    return ((seed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _by_part(part: np.ndarray, order: np.ndarray | None = None):
    """(part, index) for every part that occurs."""
    order = np.argsort(part, kind="stable") if order is None else order
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1)) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.r_[cuts[1:], len(order)]):
        yield int(part[order[a]]), order[a:b]


def _u64(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column.to_pylist()]


def deal(df: DataFrame, rest: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Documents by bucket (with other columns as c0, c1, ... of `rest`), and their number."""
    rows = df.count()
    buckets = max(shuffle_partitions(df), rows // DOCS_PER_BUCKET + 1)
    more = [F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest))).alias("rest")] if rest else []
    docs = df.select(row_key().alias("rk"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), *more)
    return docs.select(F.pmod("rk", F.lit(buckets)).cast("int").alias("bucket"), "*").repartition("bucket"), rows


def find_repeats(
    docs: DataFrame,
    rows: int,
    units_of: Callable[[np.ndarray, np.ndarray], Units],
    window: int,
    gram: int,
    pack: Callable[[list], pa.RecordBatch],
    packed_schema: str,
    decide: Callable[[pa.Table], pa.Table],
    hot_places: int = HOT_PLACES,
) -> DataFrame:
    """bucket, rk, start, length (blobs): ranges of units to remove.

    `pack(found)` lays out the stretches of one owner: (bytes, anchor's unit in it, places), places = [(rk, doc_id, anchor's
    unit in the document)]; `decide` gets all rows of an owner."""
    parts = shuffle_partitions(docs)
    seed_parts, parts = max(parts, rows // 20_000), max(parts, rows // 4_000)

    def report(table: pa.Table) -> pa.Table:
        seeds = np.concatenate([np.zeros(0, np.uint64), *(runs_of(units_of(*flat_text(p.column("text"))), window, gram).seed for p in slices(table))])
        seeds, counts = np.unique(seeds, return_counts=True)
        bucket = table.column("bucket")[0].as_py()
        out = []
        for part, rows_ in _by_part(_parts_of(seeds, seed_parts)):
            many = rows_[counts[rows_] > 1]
            out.append((part, bucket, _blob(seeds[rows_]), _blob(seeds[many]), _blob(counts[many].astype(np.uint32))))
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.table({"part": pa.array(cols[0], pa.int32()), "bucket": pa.array(cols[1], pa.int32()), "seeds": pa.array(cols[2], pa.binary()), "many": pa.array(cols[3], pa.binary()), "counts": pa.array(cols[4], pa.binary())})

    def repeated(table: pa.Table) -> pa.Table:
        each = _u64(table.column("seeds"))
        many = np.concatenate(_u64(table.column("many")))
        extra = np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("counts").to_pylist()]).astype(np.int64) - 1
        known, counts = np.unique(np.concatenate(each), return_counts=True)
        np.add.at(counts, np.searchsorted(known, many), extra)
        keep, hot = known[counts > 1], known[counts > hot_places]
        out = []
        for bucket, seeds in zip(table.column("bucket").to_pylist(), each):
            mine = np.intersect1d(seeds, keep, assume_unique=True)
            if len(mine):
                out.append((bucket, _blob(mine), _blob(np.intersect1d(mine, hot, assume_unique=True))))
        cols = list(zip(*out)) if out else [[]] * 3
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "keep": pa.array(cols[1], pa.binary()), "hot": pa.array(cols[2], pa.binary())})

    def fetch(table: pa.Table, answers: pa.Table) -> pa.Table:
        batches = []
        if table.num_rows and answers.num_rows:
            keep, hot = np.sort(np.concatenate(_u64(answers.column("keep")))), np.sort(np.concatenate(_u64(answers.column("hot"))))
            found: dict[int, dict] = {}
            for p in slices(table):
                units = units_of(*flat_text(p.column("text")))
                runs = runs_of(units, window, gram)
                if not len(runs.seed):
                    continue
                at = np.minimum(np.searchsorted(keep, runs.seed), len(keep) - 1)
                rks, ids = p.column("rk").to_pylist(), p.column("doc_id").to_pylist()
                mine = keep[at] == runs.seed
                burning = mine & np.isin(runs.seed, hot) if len(hot) else np.zeros(len(mine), bool)
                data = units.raw.tobytes()
                for lo, hi, a, doc, part in _windows(runs, np.flatnonzero(mine & ~burning), np.flatnonzero(burning), units, window, parts):
                    text = data[units.start[lo] : units.stop[hi + window - 1]]
                    found.setdefault(part, {}).setdefault((text, a - lo), []).append((rks[doc], ids[doc], a - int(units.first[doc])))
            for part in sorted(found):
                batches.append(pack([(part, table.column("bucket")[0].as_py()), [(text, offset, places) for (text, offset), places in found.pop(part).items()]]))
        return pa.Table.from_batches(batches) if batches else pack(None)

    reports = docs.groupBy("bucket").applyInArrow(report, "part int, bucket int, seeds binary, many binary, counts binary")
    answers = reports.groupBy("part").applyInArrow(repeated, "bucket int, keep binary, hot binary")
    packed = docs.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(fetch, packed_schema)
    return packed.groupBy("part").applyInArrow(decide, "bucket int, rk binary, start binary, length binary")


def _windows(runs: Runs, whole: np.ndarray, single: np.ndarray, units: Units, window: int, parts: int):
    """(first window, last window, anchor, document, owner) of every stretch to send."""
    owner = _parts_of(runs.seed[whole], parts)
    yield from zip(runs.lo[whole].tolist(), runs.hi[whole].tolist(), runs.at[whole].tolist(), runs.doc[whole].tolist(), owner.tolist())
    for i in single:
        lo = np.arange(runs.lo[i], runs.hi[i] + 1)
        owner = _parts_of(units.hashes.of(lo, lo + window), parts)
        for w, part in zip(lo.tolist(), owner.tolist()):
            yield w, w, w, int(runs.doc[i]), part


def ranges(buckets: np.ndarray, rk: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Table:
    """Answers of one owner: a row of blobs for each bucket."""
    out = [(b, _blob(rk[i].astype(np.int64)), _blob(start[i].astype(np.int32)), _blob(length[i].astype(np.int32))) for b, i in _by_part(buckets)]
    cols = list(zip(*out)) if out else [[]] * 4
    return pa.table({"bucket": pa.array(cols[0], pa.int32()), "rk": pa.array(cols[1], pa.binary()), "start": pa.array(cols[2], pa.binary()), "length": pa.array(cols[3], pa.binary())})


def covered(answers: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Start and length of the ranges of each row key of a bucket."""
    if not answers.num_rows:
        return {}
    rk, start, length = (np.concatenate([np.frombuffer(b, t) for b in answers.column(c).to_pylist()]) for c, t in (("rk", np.int64), ("start", np.int32), ("length", np.int32)))
    order = np.argsort(rk, kind="stable")
    rk, start, length = rk[order], start[order].astype(np.int64), length[order].astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, rk[1:] != rk[:-1]])
    return {int(rk[a]): (start[a:b], length[a:b]) for a, b in zip(cuts, np.r_[cuts[1:], len(rk)])}


def mask_of(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0
