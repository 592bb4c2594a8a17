"""Repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

The suffixes start at the anchors of windows that can repeat (see anchored.py);
a suffix is the text right of its anchor followed by the text left of it, read
backwards.  Every bucket sorts its suffixes and sends runs in which each keeps
only what it does not share with the one before (front coding).  The owner of a
range merges the runs with a loser tree: players carry the length they share
with the last winner, so letters known to be equal are never compared again, and
the merged order comes with its common prefixes.  Neighbours that share a whole
window, split in any way between left and right of the anchor, repeat.

A window counts as repeated if it starts anywhere else, in the same document
too.  Null or empty text has no bytes.  Repeated rows are copies of each other;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.anchored import HOT_PLACES, bytes_of, covered, deal, find_repeats, mask_of, ranges
from tidebars.llm.textkit import flat_text, slices

WINDOW = 200
GRAM = 50
PAIRS_UP_TO = 24
PACKED = "part int, bucket int, shared array<int>, tails array<binary>, rights array<int>, lefts array<int>, places array<int>, rk array<bigint>, at array<int>"
SCHEMA = pa.schema(
    [("part", pa.int32()), ("bucket", pa.int32())]
    + [(n, pa.list_(t)) for n, t in (("shared", pa.int32()), ("tails", pa.binary()), ("rights", pa.int32()), ("lefts", pa.int32()), ("places", pa.int32()), ("rk", pa.int64()), ("at", pa.int32()))]
)


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes need no look."""
    n = min(len(a), len(b))
    step = 16
    while known < n:
        end = min(known + step, n)
        if a[known:end] != b[known:end]:
            x = int.from_bytes(a[known:end]) ^ int.from_bytes(b[known:end])
            return end - (x.bit_length() + 7) // 8
        known, step = end, step * 4
    return n


def pack(found) -> pa.RecordBatch | pa.Table:
    """One sorted, front-coded run."""
    if found is None:
        return SCHEMA.empty_table()
    (part, bucket), stretches = found
    run = sorted((text[o:] + text[:o][::-1], len(text) - o, o, places) for text, o, places in stretches)
    shared, tails, last = [], [], b""
    for key, _, _, _ in run:
        n = shared_prefix(last, key)
        shared.append(n)
        tails.append(key[n:])
        last = key
    values = [[part], [bucket], [shared], [tails], [[r[1] for r in run]], [[r[2] for r in run]], [[len(r[3]) for r in run]], [[p[0] for r in run for p in r[3]]], [[p[2] for r in run for p in r[3]]]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, SCHEMA)], schema=SCHEMA)


def merge(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(length shared with the one before, run, suffix) in order, from front-coded sorted runs.

    A loser tree: node i of 1..k-1 keeps the run that lost there; keys[r] is run r's next suffix (None at its end) and
    common[r] the length it shares with the suffix that beat it, or with the last one put out."""
    k = len(runs)
    keys: list[bytes | None] = [b""] * k
    common = [0] * k
    after = [r.__next__ for r in runs]

    def advance(r: int) -> None:
        try:
            n, tail = after[r]()
        except StopIteration:
            keys[r] = None
            return
        keys[r] = keys[r][:n] + tail
        common[r] = n

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); both have their common length with the same earlier suffix."""
        x, y = keys[a], keys[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        m, n = common[a], common[b]
        if m != n:
            return (a, b) if m > n else (b, a)
        n = shared_prefix(x, y, m)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            common[b] = n
            return a, b
        common[a] = n
        return b, a

    for r in range(k):
        advance(r)
        common[r] = 0
    losers, winners = [0] * k, [0] * k + list(range(k))
    for i in range(k - 1, 0, -1):
        winners[i], losers[i] = play(winners[2 * i], winners[2 * i + 1])
    best = winners[1] if k > 1 else 0
    while keys[best] is not None:
        yield common[best], best, keys[best]
        advance(best)
        i = (best + k) // 2
        while i:
            best, losers[i] = play(best, losers[i])
            i //= 2


def repeated_shifts(keys: list[bytes], rights: list[int], lefts: list[int], common: list[int], copies: list[int], window: int) -> list[list[tuple[int, int]]]:
    """For suffixes of one anchor in order: ranges (least, most) of bytes left of the anchor at which a repeated window starts.

    common[i] is the length that i shares with i - 1."""
    m = len(keys)
    out: list[list[tuple[int, int]]] = [[(window - r, s)] if c > 1 else [] for r, s, c in zip(rights, lefts, copies)]
    if m <= PAIRS_UP_TO:
        for i in range(m):
            share = len(keys[i])
            for j in range(i + 1, m):
                share = min(share, common[j])
                right = min(share, rights[i], rights[j])
                if right < window - max(lefts[i], lefts[j]):
                    break
                if len(out[i]) == 1 == len(out[j]) and copies[i] > 1 < copies[j]:
                    continue
                left = shared_prefix(keys[i][rights[i] :], keys[j][rights[j] :])
                for e in (i, j):
                    lo, hi = max(window - right, window - rights[e]), min(left, lefts[e])
                    if lo <= hi:
                        out[e].append((lo, hi))
        return out
    share, right, reach = np.array(common), np.array(rights), np.array(lefts)
    back = sorted(range(m), key=lambda e: keys[e][rights[e] :])
    left_keys = [keys[e][rights[e] :] for e in back]
    left_share = np.array([0] + [shared_prefix(a, b) for a, b in zip(left_keys, left_keys[1:])])
    back = np.array(back)
    weight = np.array(copies)
    hits = np.zeros((window + 1, m), bool)
    for shift in range(int((window - right).min()), int(reach.max()) + 1):
        right_class = np.cumsum(share < window - shift)
        left_class = np.empty(m, np.int64)
        left_class[back] = np.cumsum(left_share < shift)
        mine = np.flatnonzero((window - right <= shift) & (shift <= reach))
        _, which = np.unique(right_class[mine] * (m + 1) + left_class[mine], return_inverse=True)
        hits[shift, mine] = np.bincount(which, weights=weight[mine])[which] > 1
    edge = np.diff(np.vstack([np.zeros(m, np.int8), hits.astype(np.int8), np.zeros(m, np.int8)]), axis=0)
    for e, lo in np.argwhere(edge.T == 1).tolist():
        out[e].append((lo, lo + int(np.argmin(hits[lo:, e])) - 1 if not hits[lo:, e].all() else window))
    return out


def decide(table: pa.Table, window: int, gram: int) -> pa.Table:
    rows = {c: table.column(c).to_pylist() for c in ("bucket", "shared", "tails", "rights", "lefts", "places", "rk", "at")}
    begins = [np.r_[0, np.cumsum(p)].tolist() for p in rows["places"]]
    seen = [0] * len(rows["bucket"])
    found: list[list] = [[], [], [], []]

    def settle(group: list) -> None:
        """group: (key, right, left, share, members) with members [(row, index)]."""
        copies = [sum(rows["places"][r][i] for r, i in g[4]) for g in group]
        if len(group) == 1 and copies[0] == 1:
            return
        shifts = repeated_shifts([g[0] for g in group], [g[1] for g in group], [g[2] for g in group], [g[3] for g in group], copies, window)
        for g, spans in zip(group, shifts):
            for lo, hi in spans:
                for r, i in g[4]:
                    a, b = begins[r][i], begins[r][i + 1]
                    found[0] += [rows["bucket"][r]] * (b - a)
                    found[1] += rows["rk"][r][a:b]
                    found[2] += [x - hi for x in rows["at"][r][a:b]]
                    found[3] += [window + hi - lo] * (b - a)

    group: list = []
    for share, r, key in merge([iter(zip(s, t)) for s, t in zip(rows["shared"], rows["tails"])]):
        i = seen[r]
        seen[r] += 1
        right, left = rows["rights"][r][i], rows["lefts"][r][i]
        if group and share < gram:
            settle(group)
            group = []
        if group and share == len(key) == len(group[-1][0]) and group[-1][1] == right:
            group[-1][4].append((r, i))
        else:
            group.append((key, right, left, share, [(r, i)]))
    settle(group) if group else None
    return ranges(*(np.array(f, np.int64) for f in found))


def remove_repeats(df: DataFrame, window: int = WINDOW, hot_places: int = HOT_PLACES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of df(doc_id, text)."""
    docs, found = _find(df, window, hot_places, ())

    def apply(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = [(doc, n, removed, spans, hashlib.sha256(kept).hexdigest()) for doc, n, removed, spans, kept in _left(table, answers)]
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.table({n: pa.array(c, t) for (n, t), c in zip((("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())), cols)})

    return docs.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(apply, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(df: DataFrame, window: int = WINDOW, hot_places: int = HOT_PLACES) -> DataFrame:
    """df with what is left of each text in place of `text`; letters cut in half are dropped, a null text stays null."""
    docs, found = _find(df, window, hot_places, tuple(c for c in df.columns if c != "text"))

    def apply(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = [kept.decode("utf-8", "ignore") for *_, kept in _left(table, answers)]
        was_null = table.column("text").is_null().to_pylist()
        return pa.table({"rest": table.column("rest"), "left_text": pa.array([None if z else t for t, z in zip(texts, was_null)], pa.string())})

    kind = docs.schema["rest"].dataType.simpleString()
    rows = docs.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(apply, f"rest {kind}, left_text string")
    return rows.select(*(F.col("left_text").alias(c) if c == "text" else F.col("rest").getField(f"c{i}").alias(c) for i, c in _numbered(df.columns)))


def _numbered(columns: list[str]) -> list[tuple[int, str]]:
    """Place of each column among those other than text."""
    others = [c for c in columns if c != "text"]
    return [(others.index(c) if c != "text" else -1, c) for c in columns]


def _find(df: DataFrame, window: int, hot_places: int, rest: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    gram = max(1, min(GRAM, window // 4))
    docs, rows = deal(df, rest)
    return docs, find_repeats(docs, rows, bytes_of, window, gram, pack, PACKED, lambda t: decide(t, window, gram), hot_places)


def _left(table: pa.Table, answers: pa.Table) -> Iterator[tuple]:
    """doc_id, bytes, removed bytes, removed runs and the remaining bytes of each row of a bucket."""
    gone = covered(answers)
    for part in slices(table):
        raw, offsets = flat_text(part.column("text"))
        for i, (rk, doc) in enumerate(zip(part.column("rk").to_pylist(), part.column("doc_id").to_pylist())):
            data, removed, spans = raw[offsets[i] : offsets[i + 1]], 0, 0
            n = len(data)
            if rk in gone:
                mask = mask_of(n, *gone[rk])
                removed, spans = int(mask.sum()), int(np.count_nonzero(np.diff(mask.astype(np.int8), prepend=0) == 1))
                data = data[~mask]
            yield doc, n, removed, spans, data.tobytes()
