"""Merkle manifest of a dataset, by source, with a proof for every document.

Leaves are numbered within their source from counts per sorted range, so no source
passes through one task.  Aligned blocks of fanout ** LEVELS leaves hash their own
subtree.  Above the blocks the trees are climbed by butterfly exchange: in round r
every block sends its ancestor to the blocks that stand at the same place in the
other subtrees of its run, gets theirs, and hashes the common parent itself.  After
the last round each block holds its subroot, and by the same exchange between
sources the root, with all siblings on the way up; nothing has to come down again.

A leaf is the digest of doc_id, source, lang, n_chars and text, each `-` if null.
Leaves ascend by doc_id (null first), then digest, so repeated rows have equal
leaves beside each other.  A source may be null or empty.  Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm.textkit import settle, shuffle_partitions, slices

FANOUT = 3
#: A block holds FANOUT ** LEVELS leaves.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(value: bytes | None) -> bytes:
    return b"-" if value is None else b"%d:%s" % (len(value), value)


def leaves_of(docs: DataFrame, tampered: Column, change: Callable[[str], str]) -> DataFrame:
    """source, doc_id, leaf, and the leaf of the text as it was given (stored)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw = [[None if v is None else v.encode() for v in part.column(c).cast(pa.string()).to_pylist()] for c in FIELDS]
                leaf, given = [], []
                for *fields, text, odd in zip(*raw, part.column("tampered").to_pylist()):
                    head = b"".join(map(field, fields))
                    leaf.append(sha256(head + field(text)).hexdigest())
                    given.append(sha256(head + field(change(text.decode()).encode())).hexdigest() if odd and text is not None else leaf[-1])
                yield pa.RecordBatch.from_arrays([part.column("source"), part.column("doc_id"), pa.array(leaf), pa.array(given)], ["source", "doc_id", "leaf", "given"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in FIELDS[1:]), F.coalesce(tampered, F.lit(False)).alias("tampered"))
    return settle(rows.mapInArrow(run, "source string, doc_id bigint, leaf string, given string"), "digests")


def numbered_leaves(leaves: DataFrame) -> DataFrame:
    """leaves(source, doc_id, leaf, ...) with part and local: the row's number among its source's rows in its part (stored)."""
    parts = shuffle_partitions(leaves)
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("leaf")]
    ranged = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    names = ranged.columns

    def number(batches):
        last, next_ = object(), 0
        for batch in batches:
            local = []
            for source in batch.column("source").to_pylist():
                if source != last:
                    last, next_ = source, 0
                local.append(next_)
                next_ += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], [*names, "local"])

    return settle(ranged.mapInArrow(number, ", ".join(f"{c} {t}" for c, t in ranged.dtypes) + ", local bigint"), "leaves")


def sources_of(leaves: DataFrame) -> DataFrame:
    """source, part, before, n, place, sources: leaves before the part, leaves and rank of the source, number of sources (stored)."""
    held = leaves.groupBy("source", "part").agg(F.count("*").alias("here"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = settle(held.withColumn("before", before).withColumn("n", F.sum("here").over(Window.partitionBy("source"))), "ranges")
    # Ranges of sources, as of leaves: where a source begins it is counted, and the counts of the parts before are added.
    first = held.filter("before = 0")
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_first("source"))) - 1
    counts = first.groupBy("part").count().withColumn("earlier", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each part
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("sources"))
    ranks = first.withColumn("own", own).join(counts.select("part", "earlier"), "part").select("source", (F.col("own") + F.col("earlier")).cast("bigint").alias("place"))
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    return settle(held.alias("l").join(ranks.alias("r"), same).select("l.source", "part", "before", "n", "place").join(F.broadcast(total)), "sources")


def runs_up(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a block, level by level; the list above `levels` levels is the last."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest(*out[-1][i : i + FANOUT]) for i in range(0, len(out[-1]), FANOUT)])
    return out


def height(n: int) -> int:
    out = 0
    while n > 1:
        n, out = -(-n // FANOUT), out + 1
    return out


def block_roots(leaves: DataFrame) -> DataFrame:
    """place, block, n, sources, node: the top of every block of leaves."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        nodes = table.column("leaf").to_pylist()
        top = runs_up(nodes, min(LEVELS, height(table.column("n")[0].as_py())))[-1][0]
        return table.slice(0, 1).select(["place", "block", "n", "sources"]).append_column("node", pa.array([top]))

    return leaves.select("place", "block", "n", "sources", "at", "leaf").groupBy("place", "block").applyInArrow(run, "place bigint, block bigint, n bigint, sources bigint, node string")


def swap(blocks: DataFrame, index: str, count: Column, level: int) -> DataFrame:
    """One round over blocks(place, block, of, node, up): runs of FANOUT ** level neighbours by `index` swap their ancestors.

    A block asks, in each other subtree of its run, the member at its own place (modulo the members there are), hashes the
    parent from what it gets, and appends the siblings (left, right) to `up`.  Blocks whose tree is complete keep still."""
    wide, run = FANOUT**level, FANOUT ** (level + 1)
    at = F.col(index)
    live = blocks.withColumn("_live", count > wide)
    mine, base = F.floor(at / wide).cast("bigint"), (F.floor(at / run) * run).cast("bigint")
    digits = F.filter(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda d: (base + d * wide < count) & (d != mine % FANOUT))
    asks = live.filter("_live").select("place", "block", F.explode(F.transform(digits, lambda d: F.struct(d.alias("digit"), (base + d * wide).alias("first")))).alias("ask"), at.alias("at"), count.alias("count"))
    members = F.least(F.lit(wide), F.col("count") - F.col("ask.first"))
    asked = asks.select("place", "block", F.col("ask.digit").alias("digit"), (F.col("ask.first") + F.col("at") % members).cast("bigint").alias("to"))
    if index == "block":
        given = blocks.select("place", F.col("block").alias("to"), F.col("node").alias("theirs"))
        got = asked.join(given, ["place", "to"])
    else:
        # Every block of a source holds its subroot; blocks ask the block of their own number, modulo those there are.
        sizes = blocks.filter("block = 0").select(F.col("place").alias("to"), F.col("blocks").alias("held"))
        given = blocks.select(F.col("place").alias("to"), F.col("block").alias("teller"), F.col("node").alias("theirs"))
        got = asked.join(sizes, "to").withColumn("teller", F.col("block") % F.col("held")).join(given, ["to", "teller"])
    met = got.groupBy("place", "block").agg(F.sort_array(F.collect_list(F.struct("digit", "theirs"))).alias("met"))
    joined = live.join(met, ["place", "block"], "left").withColumn("met", F.coalesce("met", F.array().cast("array<struct<digit:int,theirs:string>>")))
    side = lambda test: F.array_join(F.transform(F.filter("met", lambda m: test(m["digit"])), lambda m: m["theirs"]), "")
    step = F.struct(side(lambda d: d < mine % FANOUT).alias("left"), side(lambda d: d > mine % FANOUT).alias("right"))
    joined = joined.withColumn("_step", step)
    parent = F.sha2(F.concat("_step.left", "node", "_step.right"), 256)
    up = F.when(F.col("_live"), F.concat("up", F.array("_step"))).otherwise(F.col("up"))
    return settle(joined.withColumn("up", up).withColumn("node", F.when(F.col("_live"), parent).otherwise(F.col("node"))).select(*blocks.columns), "swap")


def climb(tops: DataFrame) -> DataFrame:
    """place, block, subroot, root, up (siblings from the block's top to the root) of every block."""
    size = FANOUT**LEVELS
    none = F.array().cast("array<struct<left:string,right:string>>")
    blocks = settle(tops.withColumn("blocks", F.ceil(F.col("n") / size).cast("bigint")).withColumn("up", none), "blocks")
    most = blocks.agg(F.max("blocks"), F.max("sources")).first()
    for level in range(height(most[0] or 0)):
        blocks = swap(blocks, "block", F.col("blocks"), level)
    blocks = blocks.withColumn("subroot", F.col("node"))
    for level in range(height(most[1] or 0)):
        blocks = swap(blocks, "place", F.col("sources"), level)
    return blocks.select("place", "block", "subroot", F.col("node").alias("root"), "up")


def proofs(leaves: DataFrame, tops: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]

    def run(table: pa.Table, top: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({c: pa.array([], k) for c, k in zip(names, kinds)})
        table = table.sort_by("at")
        levels = runs_up(table.column("leaf").to_pylist(), min(LEVELS, height(table.column("n")[0].as_py())))[:-1]
        subroot, root = (top.column(c)[0].as_py() for c in ("subroot", "root"))
        above = [(s["left"], s["right"]) for s in top.column("up")[0].as_py()]
        tail = "".join(a + b for a, b in above).encode()
        proof, folded = [], []
        for i, node in enumerate(table.column("given").to_pylist()):
            path = []
            at = i
            for level in levels:
                first = at - at % FANOUT
                path.append(("".join(level[first:at]), "".join(level[at + 1 : first + FANOUT])))
                at //= FANOUT
            proof.append(sha256("".join(a + b for a, b in path).encode() + tail).hexdigest())
            for a, b in (*path, *above):
                node = digest(a, node, b)
            folded.append(node)
        same = pc.equal(pa.array(folded, pa.string()), root)
        n = table.num_rows
        columns = [table.column("doc_id"), table.column("leaf"), pa.array([subroot] * n), pa.array([root] * n), pa.array(proof), pa.array(folded), same]
        return pa.table(dict(zip(names, columns)))

    keys = ("place", "block")
    kept = leaves.select(*keys, "at", "n", "doc_id", "leaf", "given")
    return kept.groupBy(*keys).cogroup(tops.groupBy(*keys)).applyInArrow(run, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, tampered: Column, change: Callable[[str], str]) -> DataFrame:
    """The manifest of docs, checked against texts that `change` has altered where `tampered` holds (null: not)."""
    leaves = numbered_leaves(leaves_of(docs, tampered, change))
    known = sources_of(leaves)
    same = F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.part") == F.col("r.part"))
    at = (F.col("before") + F.col("local")).cast("bigint")
    block = F.floor(F.col("at") / FANOUT**LEVELS).cast("bigint")
    placed = leaves.alias("l").join(known.alias("r"), same).select("doc_id", "leaf", "given", F.col("n").cast("bigint").alias("n"), "place", "sources", at.alias("at")).withColumn("block", block)
    placed = settle(placed, "placed")
    return proofs(placed, climb(block_roots(placed)))
