"""Links between documents whose sets of word shingles have a high Jaccard likeness.

A set is also a point: shingles are hashed into a few groups, and the counts of
the groups are its coordinates.  Two sets share at most the sum of their smaller
coordinates, so an R-tree over points (boxes with the largest coordinates and
least sizes below them) leaves few pairs to verify on the sets themselves.
A tree holds the sets of one cell: sets that can link agree wholly in at least
one of H + 1 groups, where H is the most they may differ by, so every set is in
the cells named by the contents of its groups, and no pair is missed.  Groups are
a few more than that, so that one of those that agree is not empty.  (Counts
alone rule out too little to be the only index: see the README.)

Equal sets are one.  In a cell, every set is first checked against the least
one; only cells that these links do not hold together are searched by the tree,
for pairs of different components, in blocks.  Components are then joined to the
documents.  Sets are named by 64-bit sums of shingle hashes.

Null or empty text, and text without words, has an empty set, links with nothing
and is its own component.  A text with fewer words than a shingle is one
shingle.  A null doc_id never names a component unless no other does.  Repeated
rows are copies of each other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm.graph import components
from tidebars.llm.textkit import Rolling, byte_values, flat_text, give_back, mix, row_key, settle, shuffle_partitions, slices, spread, word_spans

#: Groups of a point; points in cells have SMALL coordinates and the tree's boxes COARSE, sums of as many groups each.
#: Pairs that all these bounds leave are held against points of FINE coordinates before whole sets are moved.
FINE = 1024
DIMENSIONS = 256
SMALL = 128
COARSE = 16
LEAF = 32
FAN = 8
CHUNK = 2048
#: Queries and boxes, or points, that a search compares at a time.
PAIRS = 8192
CLASS_RATIO = 1.4
SLICE = 4 << 20
#: Rows with sets or points go to Python so many bytes at a time.
BATCH = 4 << 20
#: Bits that tell which rows may be asked for, in pages as Spark's bitmaps have them: 1 MB in all.
BITS = 1 << 23
PAGE = 1 << 15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ordered, and the text each belongs to."""
    start, stop, first = word_spans(raw, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = Rolling(Rolling(byte_values(_LOWER[raw])).of(start, stop))
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    owner = np.repeat(np.arange(len(n)), count)
    at = spread(first[:-1], count)
    hashes = words.of(at, at + np.minimum(n[owner], width))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]
    return hashes[fresh], owner[fresh]


def _names(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(n, np.uint64)
    np.add.at(total, owner, mix(hashes))
    return mix(total + np.bincount(owner, minlength=n).astype(np.uint64)).view(np.int64)


def classes(most: int) -> np.ndarray:
    """Largest sizes of the size classes up to one that holds `most`."""
    ends, low = [], 1
    while True:
        ends.append(max(low, int(low * CLASS_RATIO)))
        if ends[-1] >= most:
            return np.array(ends)
        low = ends[-1] + 1


def most_apart(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that stand in only one of two linked sets of sizes up to a and b, at most."""
    return (a + b) * (100 - percent) // (100 + percent)


def group_counts(ends: np.ndarray, percent: int) -> np.ndarray:
    """Groups that sets of sizes up to each of `ends` are dealt to: more than may differ, and so many that full sets fill that many.

    0 where only equal sets can link."""
    apart = most_apart(ends, ends, percent)
    groups = apart + 1
    while True:
        short = (groups * -np.expm1(-ends / groups) < 1.03 * (apart + 1) + 1) & (groups < 2 * (apart + 1))
        if not short.any():
            return np.where(apart > 0, groups, 0)
        groups = np.where(short, groups + np.maximum(groups // 16, 1), groups)


def cell_keys(hashes: np.ndarray, owner: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the cells of every set, and the set of each.

    Sets of a class and of the class above meet under the rule of the upper one.  A differing shingle spoils one group, so a
    set that fills more groups than it may differ in agrees with every partner in one that is not empty.  Empty groups say
    nothing and name a cell only for sets that fill fewer; two such sets agree in one group of all."""
    sizes = np.bincount(owner, minlength=n)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = classes(int(sizes.max() * 100 / percent) + 2)
    dealt = group_counts(ends, percent)
    kind = np.searchsorted(ends, sizes)
    keys, sets = [], []
    for up in (0, 1):
        rule = kind + up
        # The class above matters only where it holds sizes that can link.
        take = (sizes > 0) & ((up == 0) | (np.r_[0, ends][rule] + 1 <= sizes * 100 // percent))
        most = np.minimum(rule, len(ends) - 1)
        groups = np.where(take, dealt[most], 0)
        base = np.cumsum(groups) - groups
        mine = groups[owner] > 0
        cell = base[owner[mine]] + (mix(hashes[mine] ^ np.uint64(0xA5)) % groups[owner[mine]].astype(np.uint64)).astype(np.int64)
        content = np.zeros(int(groups.sum()), np.uint64)
        np.add.at(content, cell, mix(hashes[mine]))
        filled = np.bincount(cell, minlength=len(content)) > 0
        who = np.repeat(np.arange(n), groups)
        apart = most_apart(sizes, np.minimum(sizes * 100 // percent, ends[most]), percent)
        named = filled | (np.bincount(who[filled], minlength=n) <= apart)[who]
        number = spread(np.zeros(n, np.int64), groups)
        keys.append(mix(content + mix(number.astype(np.uint64) * np.uint64(1 << 20) + rule[who].astype(np.uint64)))[named])
        sets.append(who[named])
    return np.concatenate(keys), np.concatenate(sets)


def points(hashes: np.ndarray, owner: np.ndarray, n: int, size: int = DIMENSIONS) -> np.ndarray:
    group = (mix(hashes ^ np.uint64(0x5A)) % np.uint64(size)).astype(np.int64)
    return np.bincount(owner * size + group, minlength=n * size).reshape(n, size)


def _blob(point: np.ndarray) -> bytes:
    most = point.max(initial=0)
    return point.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _points(blobs: list[bytes], size: int = DIMENSIONS) -> np.ndarray:
    kinds = {size: np.uint8, 2 * size: np.uint16, 4 * size: np.uint32}
    wide = [np.frombuffer(b, kinds[len(b)]) for b in blobs]
    return np.stack(wide).astype(np.int32) if wide else np.zeros((0, size), np.int32)


def _folded(vectors: np.ndarray, size: int) -> np.ndarray:
    """Points of fewer coordinates: sums of neighbouring groups."""
    width = vectors.shape[1] // size
    return vectors.reshape(len(vectors), size, width).sum(axis=2) if width > 1 else vectors


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles that sets of these sizes need: 100 * shared >= percent * (a + b - shared)."""
    return -(-(percent * (a + b)) // (100 + percent))


class CountTree:
    """R-tree over count vectors, packed level by level along the coordinate that varies most."""

    def __init__(self, vectors: np.ndarray):
        self.points, self.sizes = vectors, vectors.sum(axis=1)
        coarse = _folded(vectors, COARSE)
        self.folded, self.order = coarse, self._packed(coarse)
        top, least = coarse[self.order], self.sizes[self.order]
        self.levels = []
        size = LEAF
        while True:
            cuts = np.arange(0, len(top), size)
            top, least = np.maximum.reduceat(top, cuts), np.minimum.reduceat(least, cuts)
            self.levels.append((top, least, size))
            if len(top) <= FAN:
                break
            size = FAN

    @staticmethod
    def _packed(vectors: np.ndarray) -> np.ndarray:
        out, todo = [], [np.argsort(vectors.sum(axis=1), kind="stable")]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                out.append(rows)
                continue
            axis = int(np.argmax(vectors[rows].std(axis=0)))
            rows = rows[np.argsort(vectors[rows, axis], kind="stable")]
            half = (len(rows) // LEAF + 1) // 2 * LEAF
            todo += [rows[half:], rows[:half]]
        return np.concatenate(out)

    def search(self, queries: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, points) that the bound does not rule out, in blocks of queries."""
        sizes, coarse = queries.sum(axis=1), _folded(queries, COARSE)
        last = len(self.levels) - 1
        # What is still to be opened waits in pieces of PAIRS, lower boxes first, so a block never holds all of its pairs.
        for q, node in _pieces(np.arange(len(queries)), 0, len(self.levels[last][0])):
            todo = [(last, q, node)]
            while todo:
                depth, q, node = todo.pop()
                top, least, size = self.levels[depth]
                fits = np.minimum(coarse[q], top[node]).sum(axis=1) >= needed(sizes[q], least[node], percent)
                q, node = q[fits], node[fits]
                below = len(self.levels[depth - 1][0]) if depth else len(self.order)
                for q, node in _pieces(q, node * size, np.minimum(size, below - node * size)):
                    if depth:
                        todo.append((depth - 1, q, node))
                        continue
                    p = self.order[node]
                    fits = np.minimum(coarse[q], self.folded[p]).sum(axis=1) >= needed(sizes[q], self.sizes[p], percent)
                    i, j = q[fits], p[fits]
                    fits = np.minimum(queries[i], self.points[j]).sum(axis=1) >= needed(sizes[i], self.sizes[j], percent)
                    yield i[fits], j[fits]


def _pieces(q: np.ndarray, first: np.ndarray | int, count: np.ndarray | int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every q with its `count` nodes from `first` on, about PAIRS at a time."""
    first, count = np.broadcast_to(first, len(q)), np.broadcast_to(count, len(q))
    step = max(1, PAIRS // max(int(count.max(initial=0)), 1))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        yield np.repeat(q[part], count[part]), spread(first[part], count[part])


def describe(df: DataFrame, width: int) -> DataFrame:
    """at, doc_id, n_shingles, name, point and its sums (small) of every row of df(at, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, owner = shingles(*flat_text(part.column("text")), width)
                n = part.num_rows
                vectors = points(hashes, owner, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("at"), part.column("doc_id"), pa.array(np.bincount(owner, minlength=n), pa.int64()), pa.array(_names(hashes, owner, n)), *(pa.array([_blob(v) for v in p], pa.binary()) for p in (vectors, _folded(vectors, SMALL)))],
                    ["at", "doc_id", "n_shingles", "name", "point", "small"],
                )

    return df.select("at", "doc_id", "text").mapInArrow(run, "at bigint, doc_id bigint, n_shingles bigint, name bigint, point binary, small binary")


def _once(keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of keys and sets, in order."""
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])
    return keys[fresh], sets[fresh]


def shared_cells(df: DataFrame, width: int, percent: int, rows: int) -> DataFrame:
    """cell, chunk, members array<bigint>: cells with two or more different sets; equal cells of an owner once."""
    parts = max(shuffle_partitions(df), rows // 5_000)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in slices(batch, limit=SLICE):
                found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
                for part in slices(run):
                    hashes, owner = shingles(*flat_text(part.column("text")), width)
                    keys, sets = cell_keys(hashes, owner, part.num_rows, percent)
                    found.append((keys, _names(hashes, owner, part.num_rows)[sets]))
                keys, who = (np.concatenate(c) for c in zip(*found))
                keys, who = _once(keys, who)
                to = (keys % np.uint64(parts)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(parts + 1))
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([keys[order[cut[p] : cut[p + 1]]].tobytes() for p in full], pa.binary()), pa.array([who[order[cut[p] : cut[p + 1]]].tobytes() for p in full], pa.binary())],
                    ["part", "keys", "sets"],
                )

    def gather(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(b, np.uint64) for b in table.column("keys").to_pylist()])
        sets = np.concatenate([np.frombuffer(b, np.int64) for b in table.column("sets").to_pylist()])
        keys, sets = _once(keys, sets)
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        stop = np.r_[cut[1:], len(keys)]
        many = stop - cut > 1
        seen, out = set(), []
        for a, b in zip(cut[many].tolist(), stop[many].tolist()):
            members = sets[a:b]
            name = int(mix(np.array([np.add.reduce(mix(members.view(np.uint64))), b - a], np.uint64)).view(np.int64).sum())
            if name not in seen:
                seen.add(name)
                out += [(name, i // CHUNK, members[i : i + CHUNK]) for i in range(0, b - a, CHUNK)]
        del keys, sets, cut, stop
        give_back()
        cols = list(zip(*out)) if out else [[]] * 3
        return pa.table({"cell": pa.array(cols[0], pa.int64()), "chunk": pa.array(cols[1], pa.int32()), "members": pa.array(cols[2], pa.list_(pa.int64()))})

    sent = df.select("text").mapInArrow(emit, "part int, keys binary, sets binary")
    return sent.groupBy("part").applyInArrow(gather, "cell bigint, chunk int, members array<bigint>").dropDuplicates(["cell", "chunk"])


def likely(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of df whose `column` (a hash) may stand in keys: every one that does, and few others while keys are few against BITS.

    For joins with few rows of a wide table: what is left out need not be shuffled."""
    bit = F.pmod(F.col(column), F.lit(BITS)).cast("int")
    page, place = F.floor(bit / PAGE).cast("int"), bit % PAGE
    pages = keys.select(page.alias("_page"), place.alias("_place")).groupBy("_page").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return df.withColumn("_page", page).join(F.broadcast(pages), "_page").filter(F.getbit(byte, place % 8) == 1).select(*df.columns)


def sets_of(df: DataFrame, names: DataFrame, width: int) -> DataFrame:
    """name, hashes (ordered blob), fine (its point) of the sets in names(name, at), each made from the row of df(at, text) that `at` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # equal rows have one name and come to one task
        for batch in batches:
            for part in slices(batch):
                hashes, owner = shingles(*flat_text(part.column("text")), width)
                cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
                fresh = [(i, n) for i, n in enumerate(part.column("name").to_pylist()) if n not in done and not done.add(n)]
                own = [hashes[cut[i] : cut[i + 1]] for i, _ in fresh]
                fine = [_blob(points(h, np.zeros(len(h), np.int64), 1, FINE)[0]) for h in own]
                yield pa.RecordBatch.from_arrays([pa.array([n for _, n in fresh], pa.int64()), pa.array([h.tobytes() for h in own], pa.binary()), pa.array(fine, pa.binary())], ["name", "hashes", "fine"])

    return likely(df.select("at", "text"), names, "at").join(names, "at").select("name", "text").mapInArrow(run, "name bigint, hashes binary, fine binary")


def verified(pairs: DataFrame, df: DataFrame, boxes: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs(a, b) that link; only sets that stand in a pair are made and moved."""
    pairs = settle(pairs, "pairs", BATCH)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    names = settle(boxes.select("name", "at").join(ends, "name", "left_semi"), "names")
    sets = settle(sets_of(df, names, width), "sets", BATCH)
    pairs = settle(_bounded(pairs, sets, percent, "fine", FINE), "pairs", BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "x"):
                keep = []
                for x, y in zip(part.column("x"), part.column("y")):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int(np.count_nonzero(y[at] == x))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(keep)), part.column("b").filter(pa.array(keep))], ["a", "b"])

    both = pairs.join(sets.select(F.col("name").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("name").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _bounded(pairs: DataFrame, boxes: DataFrame, percent: int, column: str = "point", size: int = DIMENSIONS) -> DataFrame:
    """Those of pairs(a, b) whose points do not rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, (1 << 20) // size)
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                x, y = (_points(part.column(c).to_pylist(), size) for c in ("p", "q"))
                keep = pa.array(np.minimum(x, y).sum(axis=1) >= needed(x.sum(axis=1), y.sum(axis=1), percent))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])
            give_back()

    both = pairs.join(boxes.select(F.col("name").alias("a"), F.col(column).alias("p")), "a").join(boxes.select(F.col("name").alias("b"), F.col(column).alias("q")), "b")
    return both.select("a", "b", "p", "q").mapInArrow(run, "a bigint, b bigint")


def _across(cells: DataFrame, roots: DataFrame, boxes: DataFrame, percent: int) -> DataFrame:
    """a, b of different components in cells(cell, chunk, member) that hold several, by trees over blocks of the cells."""
    member = cells.join(roots.withColumnRenamed("node", "member"), "member", "left").withColumn("root", F.coalesce("root", "member"))
    split = member.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("chunk").alias("chunks")).filter("lo != hi").select("cell", "chunks")
    open_ = member.join(split, "cell").join(boxes.select(F.col("name").alias("member"), F.col("small").alias("point")), "member")
    # Block (i, j), i <= j, of a cell compares its chunks i and j; chunk c belongs to the blocks (i, c) and (c, j).
    blocks = F.transform(F.sequence(F.lit(0), F.col("chunks")), lambda o: F.struct(F.least(o, F.col("chunk")).alias("i"), F.greatest(o, F.col("chunk")).alias("j")))
    dealt = open_.withColumn("block", F.explode(blocks)).select("cell", "block.i", "block.j", "chunk", "member", "root", "point")

    def search(table: pa.Table) -> pa.Table:
        chunk, name, root = (table.column(c).to_numpy() for c in ("chunk", "member", "root"))
        vectors = _points(table.column("point").to_pylist(), SMALL)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        found = [np.zeros((0, 2), np.int64)]
        if len(left) and len(right):
            for q, p in CountTree(vectors[right]).search(vectors[left], percent):
                q, p = left[q], right[p]
                keep = root[q] != root[p]
                found.append(np.stack([np.minimum(name[q[keep]], name[p[keep]]), np.maximum(name[q[keep]], name[p[keep]])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy("cell", "i", "j").applyInArrow(search, "a bigint, b bigint").distinct()


def component_roots(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """at, doc_id, n_shingles, root (a number for each component) for every row of df(at, doc_id, text)."""
    described = settle(describe(df, width), "described", BATCH)
    rows = described.count()
    cells = settle(shared_cells(df, width, percent, rows), "cells", BATCH)
    single = cells.select("cell", "chunk", F.explode("members").alias("member"))
    names = single.select(F.col("member").alias("name")).distinct()
    same = F.min(F.struct("at", "point", "small")).alias("one")
    # An inner join: a semi join is moved below the bitmap, and shuffles all rows.
    boxes = settle(likely(described, names, "name").join(names, "name").groupBy("name").agg(same).select("name", "one.*"), "boxes")
    # The member that meets most others (an original among its edits) is the centre of each of its cells, so the cells of
    # a family mostly propose the same pairs, and pairs that link.
    crowd = single.groupBy("cell").agg(F.count("*").alias("held"))
    score = single.join(crowd, "cell").groupBy("member").agg(F.sum("held").alias("score"))
    first = single.join(score, "member").groupBy("cell").agg(F.max(F.struct("score", "member")).alias("first"))
    stars = single.join(first.select("cell", F.col("first.member").alias("a")), "cell").filter("a != member").select("a", F.col("member").alias("b")).distinct()
    links = settle(verified(_bounded(stars, boxes, percent, "small", SMALL), df, boxes, width, percent), "links", BATCH)
    roots = components(links)
    more = settle(verified(_bounded(_across(single, roots, boxes, percent), boxes, percent), df, boxes, width, percent), "links", BATCH)
    if more.head(1):
        roots = components(links.unionByName(more))
    return described.join(roots.select(F.col("node").alias("name"), "root"), "name", "left").select("at", "doc_id", "n_shingles", F.coalesce("root", "name").alias("root"))


def component_ids(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of df(doc_id, text)."""
    placed = component_roots(df.select(row_key().alias("at"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"), width, percent)
    some = placed.filter("n_shingles > 0")
    least = some.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    none = placed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.join(least, "root").select("doc_id", "n_shingles", "component_id").unionByName(none)


def one_of_each(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The row with the least doc_id of each component of df, and every row without words; df's columns."""
    keyed = df.select(row_key().alias("at"), F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns))).alias("row"))
    placed = settle(component_roots(df.select(row_key().alias("at"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"), width, percent), "placed")
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("at"))
    chosen = placed.filter("n_shingles > 0").groupBy("root").agg(F.min(order).alias("o")).select("o.at", F.lit(False).alias("blank"))
    blank = placed.filter("n_shingles = 0").select("at", F.lit(True).alias("blank")).distinct()
    kept = keyed.join(chosen.unionByName(blank), "at")
    kept = kept.withColumn("copy", F.row_number().over(Window.partitionBy("at").orderBy("at"))).filter("blank or copy = 1")
    return kept.select(*(F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(df.columns)))
