"""Near-duplicate vectors by NN-descent.

Each vector keeps a list of its nearest neighbours of the same label.  Lists
start from blocks of vectors that lie together on random lines; then, round by
round, every vector introduces its neighbours (both ways) to each other, and
whoever finds a nearer one takes it, until few lists change.  Pairs over the
threshold are the links, and their components the groups of near copies.

A list whose last entry is still over the threshold is saturated: such a vector
may have more links than places.  Its list is enlarged twice.  A second list
holds its nearest vectors of other components; introductions between saturated
vectors, at hosts that know both lists, fill it until no link between two
components is found.  And inside its own component it is compared with every
member, in blocks, so that large groups lose no link; only counts leave those
blocks.

A sample of vectors, large enough to hold AUDIT_LINKED with links or AUDIT_MOST
in all, is compared with all others; a vector passes if all its links are found.
While too few pass, lists get more starts, and after MORE_STARTS of them all
vectors of a label are compared in blocks.  A sample with too few links to judge
by asks for starts until one of them finds no new link.

The search works on unit vectors in half precision; whether a pair links is
decided in double precision, and every pair that half precision leaves open is kept until then.  Equal vectors of one label are one, with a count.  A null, zero or non-finite
vector, one with null components, or without label links with nothing and is its
own component.  Vectors of different lengths do not link.  A null vec_id gets a
null component.  Repeated rows are copies of each other; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.graph import components
from tidebars.llm.textkit import settle

NEIGHBOURS = 12
START_BLOCK = 64
STARTS = 2
MOST_ROUNDS = 8
FEW_CHANGES = 0.002
AUDIT_ROWS = 200
AUDIT_LINKED = 50
AUDIT_MOST = 3200
RECALL = 0.98
MORE_STARTS = 4
TABLE = 64
#: More than the error of a cosine of unit vectors in half precision (2 * 2^-11, by Cauchy-Schwarz).
ROUGH = 0.002
FOUND = "a bigint, b bigint, cos double, link int"
BLOCK = 1024
SEED = 5


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, kind (hash of label and length), v array<double> of the rows that may link."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v"), F.col(label).cast("string").alias("label"))
    rows = rows.filter("vec_id is not null and v is not null and label is not null").filter(~bad).filter(F.exists("v", lambda x: x != 0))
    return rows.select("vec_id", F.xxhash64("label", F.size("v")).alias("kind"), "v")


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _rough(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float16).reshape(len(blobs), -1).astype(np.float32)


def packed(rows: DataFrame) -> DataFrame:
    """vec_id, kind, vector (blob of doubles) of every usable row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            flat, ends = lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())
            # Adding 0 turns -0 into 0, which it equals.
            blobs = [(flat[e - n : e] + 0.0).tobytes() for e, n in zip(ends, np.diff(np.r_[0, ends]))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("kind"), pa.array(blobs, pa.binary())], ["vec_id", "kind", "vector"])

    return rows.mapInArrow(run, "vec_id bigint, kind bigint, vector binary")


def searched(nodes: DataFrame) -> DataFrame:
    """node, kind, rough (unit vector in half precision), root (at first the node itself) of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rough = [_unit([x])[0].astype(np.float16).tobytes() for x in b.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("kind"), pa.array(rough, pa.binary())], ["node", "kind", "rough"])

    return nodes.select("node", "kind", "vector").mapInArrow(run, "node bigint, kind bigint, rough binary").withColumn("root", F.col("node"))


def _spans(close: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """Pairs of rows that hold together each group of `close`, and the group of every row."""
    left, right, group = [], [], np.arange(len(close))
    todo = close.any(axis=1)
    for i in np.flatnonzero(todo):
        if not todo[i]:
            continue
        queue = [i]
        todo[i] = False
        while queue:
            at = queue.pop()
            for j in np.flatnonzero(close[at] & todo):
                left.append(at)
                right.append(j)
                queue.append(j)
                todo[j], group[j] = False, i
    return left, right, group


def _found(parts: list[tuple]) -> pa.Table:
    cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * 4
    return pa.table({n: pa.array(c.astype(t)) for n, c, t in zip(("a", "b", "cos", "link"), cols, (np.int64, np.int64, np.float64, np.int32))})


def _links(names: np.ndarray, cos: np.ndarray, least: float, rough: float = ROUGH) -> tuple:
    """Trees over the pairs that link for certain, and every pair between two trees that `rough` leaves open."""
    left, right, group = _spans(cos >= least + rough)
    i, j = np.nonzero(np.triu((cos >= least - rough) & (cos < least + rough)))
    open_ = group[i] != group[j]
    i, j = np.r_[np.array(left, np.int64), i[open_]], np.r_[np.array(right, np.int64), j[open_]]
    return names[i], names[j], cos[i, j], np.ones(len(i))


def _cosines(x: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Cosines of rows of different roots; -2 for the others."""
    return np.where(root[:, None] == root[None, :], -2, x @ x.T)


def _starts(nodes: DataFrame, seed: int, k: int, least: float) -> DataFrame:
    """a, b, cos, link: the k nearest of each node inside its block on one random line, and links that hold blocks together."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [float(_rough([x])[0] @ np.random.default_rng(SEED + seed).normal(size=len(x) // 2)) for x in b.column("rough").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("kind"), b.column("rough"), b.column("root"), pa.array(at, pa.float64())], ["node", "kind", "rough", "root", "at"])

    placed = nodes.mapInArrow(place, "node bigint, kind bigint, rough binary, root bigint, at double")
    # Projections of unit vectors on a normal line are about normal: cells are equal shares of it, about START_BLOCK rows each.
    sizes = nodes.groupBy("kind").agg(F.count("*").alias("n"))
    share = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("at") * -1.702))
    cells = F.greatest(F.lit(1), F.ceil(F.col("n") / START_BLOCK))
    blocks = placed.join(sizes, "kind").withColumn("cell", F.floor(share * cells).cast("bigint"))
    # Near copies lie on one place and would crowd a cell; a salt keeps blocks bounded.
    crowd = blocks.groupBy("kind", "cell").agg(F.count("*").alias("held"))
    salted = blocks.join(crowd, ["kind", "cell"]).withColumn("salt", F.pmod(F.xxhash64("node", F.lit(seed)), F.ceil(F.col("held") / (2 * START_BLOCK))))

    def near(table: pa.Table) -> pa.Table:
        names, cos = table.column("node").to_numpy(), _cosines(_rough(table.column("rough").to_pylist()), table.column("root").to_numpy())
        some = min(k, len(names) - 1)
        if not some:
            return _found([])
        best = np.argpartition(-cos, some - 1, axis=1)[:, :some].ravel()
        rows = np.repeat(np.arange(len(names)), some)
        keep = cos[rows, best] > -2
        rows, best = rows[keep], best[keep]
        return _found([(names[rows], names[best], cos[rows, best], np.zeros(len(rows))), _links(names, cos, least)])

    return salted.select("kind", "cell", "salt", "node", "rough", "root").groupBy("kind", "cell", "salt").applyInArrow(near, FOUND)


def _keep_best(edges: DataFrame, k: int) -> DataFrame:
    """a, list of the k best (cos, b, old) of edges(a, b, cos, old); an edge known before stays old."""
    once = edges.groupBy("a", "b").agg(F.max("cos").alias("cos"), F.max("old").alias("old"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("cos", "b", "old")), False), 1, k)
    # Candidates are cut to k in each part first, so no list grows beyond parts * k.
    part = once.groupBy("a", F.pmod("b", F.lit(8)).alias("part")).agg(best.alias("list"))
    return part.groupBy("a").agg(F.slice(F.sort_array(F.flatten(F.collect_list("list")), False), 1, k).alias("list"))


def _edges(lists: DataFrame) -> DataFrame:
    return lists.select("a", F.explode("list").alias("e")).select("a", "e.b", "e.cos", "e.old")


def _introduce(lists: DataFrame, nodes: DataFrame, rows: int, k: int, least: float, turn: int, own: DataFrame | None = None) -> DataFrame:
    """a, b, cos, link of pairs of different roots that meet at a common neighbour (of lists or of the known pairs `own`), one of them new there: what improves a's list, and links."""
    edges = _edges(lists)
    worst = lists.select(F.col("a").alias("b"), F.when(F.size("list") >= k, F.element_at("list", -1).getField("cos")).otherwise(-2.0).alias("worst"))
    both = edges.select(F.col("a").alias("host"), "b", "old").unionByName(edges.select(F.col("b").alias("host"), F.col("a").alias("b"), "old"))
    if own is not None:
        both = both.unionByName(own.select(F.col("a").alias("host"), "b", F.lit(1).alias("old"))).unionByName(own.select(F.col("b").alias("host"), F.col("a").alias("b"), F.lit(1).alias("old")))
    both = both.groupBy("host", "b").agg(F.min("old").alias("old"))
    fresh = both.groupBy("host").agg(F.min("old").alias("any"), F.count("*").alias("n")).filter("any = 0").select("host", "n")
    guests = both.join(fresh, "host").join(worst, "b", "left").fillna(-2.0, ["worst"]).join(nodes.select(F.col("node").alias("b"), "rough", "root"), "b")
    # A host with very many guests deals them out to tables, others every round.
    guests = guests.withColumn("seat", F.pmod(F.xxhash64("b", "host", F.lit(turn)), F.ceil(F.col("n") / TABLE)))
    rooms = max(1, rows // 256)

    def meet(table: pa.Table) -> pa.Table:
        host, seat, names, old, worst_, root = (table.column(c).to_numpy() for c in ("host", "seat", "b", "old", "worst", "root"))
        x = _rough(table.column("rough").to_pylist())
        order = np.lexsort((seat, host))
        cut = np.flatnonzero(np.r_[True, (np.diff(host[order]) != 0) | (np.diff(seat[order]) != 0)])
        out = []
        for a, b in zip(cut, np.r_[cut[1:], len(order)]):
            rows_ = order[a:b]
            cos = _cosines(x[rows_], root[rows_])
            news = ((old[rows_][:, None] == 0) | (old[rows_][None, :] == 0)) & (cos > -2)
            i, j = np.nonzero(news & (cos > worst_[rows_][:, None]))
            out.append((names[rows_[i]], names[rows_[j]], cos[i, j], np.zeros(len(i))))
            if (cos[news] >= least - ROUGH).any():
                out.append(_links(names[rows_], cos, least))
        return _found(out)

    dealt = guests.select(F.pmod(F.xxhash64("host", "seat"), F.lit(rooms)).alias("room"), "host", "seat", "b", "old", "worst", "rough", "root")
    return dealt.groupBy("room").applyInArrow(meet, FOUND)


def descend(nodes: DataFrame, rows: int, starts: range, k: int, least: float, lists: DataFrame | None = None, own: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Lists (a, list) of neighbours of other roots after rounds of introductions, and the links (a, b, cos) met on the way."""
    links = None

    def take(found: DataFrame, known: DataFrame | None) -> DataFrame:
        nonlocal links
        found = settle(found, "found")
        met = found.filter("link = 1").select("a", "b", "cos")
        links = met if links is None else links.unionByName(met)
        fresh = found.filter("link = 0").select("a", "b", "cos", F.lit(0).alias("old"))
        return fresh if known is None else known.unionByName(fresh)

    pool = None if lists is None else _edges(lists).withColumn("old", F.lit(1))
    for seed in starts:
        pool = take(_starts(nodes, seed, k, least), pool)
    lists = settle(_keep_best(pool, k), "lists")
    for turn in range(MOST_ROUNDS):
        pool = take(_introduce(lists, nodes, rows, k, least, starts[0] * MOST_ROUNDS + turn, own), _edges(lists).withColumn("old", F.lit(1)))
        lists = settle(_keep_best(pool, k), "lists")
        changed = lists.select(F.size(F.filter("list", lambda e: e.getField("old") == 0)).alias("n")).agg(F.sum("n")).first()[0] or 0
        if changed <= FEW_CHANGES * rows * k:
            break
    return lists, links


def checked(links: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """a, b whose cosine in double precision reaches `least`; only those near it are computed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([bool(_unit([x])[0] @ _unit([y])[0] >= least) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    once = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cos").groupBy("a", "b").agg(F.max("cos").alias("cos"))
    near = once.filter((F.col("cos") < least + ROUGH) & (F.col("cos") >= least - ROUGH))
    exact = near.join(nodes.select(F.col("node").alias("a"), F.col("vector").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("vector").alias("y")), "b")
    return once.filter(F.col("cos") >= least + ROUGH).select("a", "b").unionByName(exact.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"))


def bridges(search: DataFrame, lists: DataFrame, links: DataFrame, roots: DataFrame, nodes: DataFrame, starts: range, k: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The links (a, b) and roots with what saturated vectors of different components have in common.

    A link that no list holds has two saturated ends, so only those search, for vectors of other components; every pass
    that finds a link makes components fewer."""
    full = lists.filter((F.size("list") >= k) & (F.element_at("list", -1).getField("cos") >= least - ROUGH)).select(F.col("a").alias("node"))
    full = settle(search.drop("root").join(full, "node"), "crowded")
    while True:
        crowd = full.join(roots, "node")
        several = crowd.groupBy("kind").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("kind")
        crowd = settle(crowd.join(several, "kind").select("node", "kind", "rough", "root"), "crowd")
        rows = crowd.count()
        if not rows:
            return links, roots
        own = _edges(lists).join(crowd.select(F.col("node").alias("a")), "a").join(crowd.select(F.col("node").alias("b")), "b").select("a", "b")
        far, met = descend(crowd, rows, starts, k, least, own=settle(own, "own"))
        met = met.unionByName(_edges(far).filter(F.col("cos") >= least - ROUGH).select("a", "b", "cos"))
        more = settle(checked(met, nodes, least), "bridges")
        if not more.head(1):
            return links, roots
        links = links.unionByName(more)
        roots = components(links)


def audit(nodes: DataFrame, roots: DataFrame, least: float) -> tuple[int, int]:
    """Vectors with links in a bounded sample, by comparing each with all others; and those whose links all lie in one component."""
    rows = AUDIT_ROWS
    while True:
        linked, whole = _audited(nodes, roots, least, rows)
        if linked >= AUDIT_LINKED or rows >= AUDIT_MOST:
            return linked, whole
        rows *= 4


def _audited(nodes: DataFrame, roots: DataFrame, least: float, rows: int) -> tuple[int, int]:
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(rows).select("node", "kind", "vector").collect()
    held: dict[int, list] = {}
    for r in sample:
        held.setdefault(r.kind, []).append((r.node, bytes(r.vector)))
    shared = nodes.sparkSession.sparkContext.broadcast({k: (np.array([n for n, _ in rs]), _unit([v for _, v in rs])) for k, rs in held.items()})  # `rows` vectors

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, node = b.column("kind").to_numpy(), b.column("node").to_numpy()
            vectors = b.column("vector").to_pylist()
            for k in np.unique(kind).tolist():
                if k in shared.value:
                    names, x = shared.value[k]
                    mine = np.flatnonzero(kind == k)
                    i, j = np.nonzero(_unit([vectors[m] for m in mine]) @ x.T >= least)
                    keep = node[mine[i]] != names[j]
                    yield pa.RecordBatch.from_arrays([pa.array(node[mine[i]][keep]), pa.array(names[j][keep])], ["node", "other"])

    truth = nodes.select("kind", "node", "vector").mapInArrow(compare, "node bigint, other bigint")
    joined = truth.join(roots, "node", "left").join(roots.select(F.col("node").alias("other"), F.col("root").alias("root2")), "other", "left")
    each = joined.groupBy("other").agg(F.bool_and(F.coalesce(F.col("root") == F.col("root2"), F.lit(False))).alias("whole"))
    r = each.agg(F.count("*").alias("n"), F.count_if("whole").alias("hit")).first()
    return r.n, r.hit


def _blocked(member: DataFrame) -> DataFrame:
    """root, i, j, block, node, copies, vector of member(root, node, copies, vector): every pair of blocks of a root."""
    size = member.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    member = member.join(size, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    others = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    return member.withColumn("pair", F.explode(others)).select("root", "pair.i", "pair.j", "block", "node", "copies", "vector")


def all_links(nodes: DataFrame, least: float) -> DataFrame:
    """a, b that hold the groups of each label together: every vector against all of its kind, in blocks."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, name = table.column("block").to_numpy(), table.column("node").to_numpy()
        x = _unit(table.column("vector").to_pylist())
        cos = x @ x.T
        np.fill_diagonal(cos, -2)
        if i != j:
            cos[block[:, None] == block[None, :]] = -2
        a, b, _, _ = _links(name, cos, least, 0.0)
        return pa.table({"a": a, "b": b})

    member = nodes.select(F.col("kind").alias("root"), "node", "copies", "vector")
    return _blocked(member).groupBy("root", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _inside(nodes: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """node, linked (vectors over the threshold, other nodes only): every member against its whole component, in blocks."""
    member = nodes.join(roots, "node").select("root", "node", "copies", "vector")
    dealt = _blocked(member)

    def count(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, name, copies = (table.column(c).to_numpy() for c in ("block", "node", "copies"))
        x = _unit(table.column("vector").to_pylist())
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        hit = x[left] @ x[right].T >= least
        if i == j:
            np.fill_diagonal(hit, False)
            return pa.table({"node": name[left], "linked": hit @ copies[right]})
        return pa.table({"node": np.r_[name[left], name[right]], "linked": np.r_[hit @ copies[right], hit.T @ copies[left]]})

    return dealt.groupBy("root", "i", "j").applyInArrow(count, "node bigint, linked bigint").groupBy("node").agg(F.sum("linked").alias("linked"))


def near_groups(vectors: DataFrame, least: float = 0.93, k: int = NEIGHBOURS, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    named = settle(packed(usable(vectors, vec_id, embedding, label)), "vectors")
    nodes = settle(named.groupBy("kind", "vector").agg(F.min("vec_id").alias("name"), F.count("*").alias("copies")).select(F.xxhash64("kind", "vector").alias("node"), "name", "kind", "copies", "vector"), "nodes")
    search = settle(searched(nodes), "search")
    rows = search.count()
    lists, links, known = None, None, None
    for turn in range(MORE_STARTS + 1):
        starts = range(STARTS * turn, STARTS * (turn + 1))
        lists, met = descend(search, rows, starts, k, least, lists)
        met = met.unionByName(_edges(lists).filter(F.col("cos") >= least - ROUGH).select("a", "b", "cos"))
        met = settle(checked(met, nodes, least), "links")
        links = met if links is None else links.unionByName(met)
        links, roots = bridges(search, lists, links, components(links), nodes, starts, k, least)
        true, whole = audit(nodes, roots, least)
        # A node joins a component, or a component another, with every new link that matters.
        merged = tuple(roots.agg(F.count("*"), F.countDistinct("root")).first())
        if whole >= RECALL * true if true >= AUDIT_LINKED else whole == true and merged == known:
            break
        known = merged
    else:
        roots = components(settle(all_links(nodes, least), "links"))
    linked = _inside(nodes, roots, least)
    member = nodes.join(roots, "node", "left").join(linked, "node", "left").select("kind", "vector", "name", F.coalesce("root", "node").alias("root"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least_name = member.groupBy("root").agg(F.min("name").alias("component_id"))
    groups = member.join(least_name, "root").select("kind", "vector", "n_links", "component_id")
    found = named.join(groups, ["kind", "vector"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id")).join(found, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
