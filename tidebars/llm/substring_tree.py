"""Repeated word windows by prefix-partitioned suffix trees.

The suffixes that can repeat (see anchored.py) are split into groups that fit in
memory by a prefix of words around their anchor; where that prefix has too many
places it is lengthened to the whole window.  Each group's suffixes, cut at the
window length, are sorted by word codes: neighbours' common prefixes are the
tree, and its nodes as deep as the window are the repeats.  A window is removed
where its node also holds a place in a document with a smaller id.

Null or empty text has no words.  A null doc_id counts as larger than any other;
rows with equal doc_id do not remove each other's windows.  Repeated rows give
repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidebars.llm.anchored import HOT_PLACES, covered, deal, find_repeats, mask_of, ranges, words_of
from tidebars.llm.textkit import flat_text, slices, spread, word_spans

WINDOW = 13
GRAM = 6
LAST_ID = np.iinfo(np.int64).max
PACKED = "part int, bucket int, texts array<binary>, offsets array<int>, of array<int>, rk array<bigint>, doc array<bigint>, at array<int>"


def pack(found) -> pa.RecordBatch | pa.Table:
    schema = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("texts", pa.list_(pa.binary())), ("offsets", pa.list_(pa.int32())), ("of", pa.list_(pa.int32())), ("rk", pa.list_(pa.int64())), ("doc", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])
    if found is None:
        return schema.empty_table()
    (part, bucket), stretches = found
    of = [i for i, (_, _, places) in enumerate(stretches) for _ in places]
    flat = [p for _, _, places in stretches for p in places]
    values = [[part], [bucket], [[t for t, _, _ in stretches]], [[o for _, o, _ in stretches]], [of], [[p[0] for p in flat]], [[LAST_ID if p[1] is None else p[1] for p in flat]], [[p[2] for p in flat]]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)


def deep_nodes(codes: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For the suffixes codes[s:s + depth], the node of that depth (a number) each belongs to."""
    cells = codes[starts[:, None] + np.arange(depth)].astype(np.uint64)
    pairs = [(cells[:, i] << np.uint64(32)) | (cells[:, i + 1] if i + 1 < depth else np.uint64(0)) for i in range(0, depth, 2)]
    order = np.lexsort(pairs[::-1])
    leaf = cells[order]
    same = leaf[1:] == leaf[:-1]
    common = np.where(same.all(axis=1), depth, np.argmin(same, axis=1))  # common prefix of neighbouring leaves
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(np.r_[0, common < depth])
    return node


def decide(table: pa.Table, window: int) -> pa.Table:
    texts = [t for row in table.column("texts").to_pylist() for t in row]
    sizes = [len(row) for row in table.column("texts").to_pylist()]
    offsets = np.array([o for row in table.column("offsets").to_pylist() for o in row], np.int64)
    base = np.cumsum(sizes) - sizes
    of = np.concatenate([np.array(row, np.int64) + b for row, b in zip(table.column("of").to_pylist(), base)])
    places = np.array([len(row) for row in table.column("of").to_pylist()])
    bucket = np.repeat(table.column("bucket").to_numpy(), places)
    rk, doc, at = (np.concatenate([np.array(row, np.int64) for row in table.column(c).to_pylist()]) for c in ("rk", "doc", "at"))
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words])
    codes = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy()
    first = np.cumsum(counts) - counts
    windows = counts - window + 1
    node = deep_nodes(codes, spread(first, windows), window)
    owner = np.repeat(np.arange(len(texts)), windows)
    least_of_text = np.full(len(texts), LAST_ID)
    np.minimum.at(least_of_text, of, doc)
    least = np.full(node.max() + 1, LAST_ID)
    np.minimum.at(least, node, least_of_text[owner])
    window_at = np.cumsum(windows) - windows
    # Every place of a stretch with every window of it.
    place = np.repeat(np.arange(len(of)), windows[of])
    which = spread(window_at[of], windows[of])
    gone = least[node[which]] < doc[place]
    place, which = place[gone], which[gone]
    if not len(place):
        return ranges(*[np.zeros(0, np.int64)] * 4)
    begin = np.r_[True, (place[1:] != place[:-1]) | (which[1:] != which[:-1] + 1)]
    head = np.flatnonzero(begin)
    tail = np.r_[head[1:], len(place)] - 1
    p = place[head]
    start = at[p] - offsets[of[p]] + which[head] - window_at[of[p]]
    return ranges(bucket[p], rk[p], start, which[tail] - which[head] + window)


def remove_repeats(df: DataFrame, window: int = WINDOW, hot_places: int = HOT_PLACES, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text) for every row of df(doc_id, text)."""
    docs, rows = deal(df)
    found = find_repeats(docs, rows, words_of, window, min(GRAM, window), pack, PACKED, lambda t: decide(t, window), hot_places)

    def apply(table: pa.Table, answers: pa.Table) -> pa.Table:
        gone, out = covered(answers), []
        for part in slices(table):
            raw, offsets = flat_text(part.column("text"))
            _, _, first = word_spans(raw, offsets)
            data = raw.tobytes()
            for i, (rk, doc) in enumerate(zip(part.column("rk").to_pylist(), part.column("doc_id").to_pylist())):
                words = data[offsets[i] : offsets[i + 1]].split()
                n, removed = int(first[i + 1] - first[i]), 0
                if rk in gone:
                    mask = mask_of(n, *gone[rk])
                    removed = int(mask.sum())
                    words = [w for w, m in zip(words, mask.tolist()) if not m]
                kept = b" ".join(words)
                out.append((doc, n, removed, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
        cols = list(zip(*out)) if out else [[]] * (4 + with_text)
        fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())][: 4 + with_text]
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(fields, cols)})

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return docs.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(apply, schema)
