import random
from collections import defaultdict

import numpy as np
import pytest

from tidebars.llm import jaccard_join
from tidebars.llm.graph import components
from tidebars.llm.jaccard_join import CountTree, cell_keys, component_ids, needed
from tidebars.llm.textkit import settle

RND = random.Random(12)
VOCAB = ["".join(RND.choice("abcdeé") for _ in range(RND.randint(1, 5))) for _ in range(400)]


def say(n):
    return [RND.choice(VOCAB) for _ in range(n)]


def edited(words, k):
    words = list(words)
    for _ in range(k):
        words[RND.randrange(len(words))] = RND.choice(VOCAB)
    return words


def rows():
    out = [None, "", " \n", "one", "One", "two words", "Two  WORDS", "a b c", "a b c d", "ÀB c d", "àb c d"]
    for n in (5, 9, 12, 30, 60, 150, 400):
        for _ in range(4):
            base = say(n)
            out.append(" ".join(base))
            for k in (0, 1, 1, 2, 3, n // 60, n // 40):
                out.append((" " if k else "\t").join(edited(base, k)))
            chain = base
            for _ in range(4):
                chain = edited(chain, max(1, n // 80))
                out.append(" ".join(chain) + " tail" * RND.randint(0, 2))
    out += [" ".join(w.upper() for w in say(80))] * 3 + ["la la " * 500, "la la " * 501]
    docs = [(i * 3, t) for i, t in enumerate(out)]
    RND.shuffle(docs)
    return docs + [(None, out[40]), (None, " ".join(say(20))), (9, out[30]), (9, out[30])]


def brute(docs, width, percent):
    import re

    sets = []
    for d, t in docs:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set())
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [docs[i][0] for i in members if docs[i][0] is not None]
        out += [(docs[i][0], len(sets[i]), min(ids) if ids else None) for i in members]
    return out


DOCS = rows()
KEY = lambda r: tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("width,percent,chunk", [(3, 90, 2048), (5, 80, 2048), (3, 90, 3), (1, 60, 2048)])
def test_equals_all_pairs(spark, monkeypatch, width, percent, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    df = spark.createDataFrame([(*d, 1, "x") for d in DOCS], "doc_id bigint, text string, name int, root string")
    got = [tuple(r) for r in component_ids(df, width, percent).collect()]
    assert sorted(got, key=KEY) == sorted(brute(DOCS, width, percent), key=KEY)


def test_no_rows(spark):
    assert component_ids(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_sets_that_link_share_a_cell():
    rnd = np.random.default_rng(1)
    for percent in (60, 80, 90, 95):
        for n in (1, 4, 8, 9, 10, 19, 40, 41, 120, 700):
            a = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
            for _ in range(5):
                cut = rnd.integers(0, n // 5 + 1)
                b = np.unique(np.r_[a[cut:], rnd.integers(0, 1 << 62, rnd.integers(0, n // 8 + 1)).astype(np.uint64)])
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                    keys, who = cell_keys(np.r_[a, b], np.r_[np.zeros(len(a), int), np.ones(len(b), int)], 2, percent)
                    assert set(keys[who == 0]) & set(keys[who == 1])


def test_tree_loses_no_pair():
    rnd = np.random.default_rng(3)
    points = rnd.poisson(2.0, (700, 256))
    points[300:500] = points[100:300] + (rnd.random((200, 256)) < 0.1)
    queries = points[::3]
    got = {(int(q), int(p)) for qs, ps in CountTree(points).search(queries, 90) for q, p in zip(qs, ps)}
    sizes = points.sum(axis=1)
    want = {(i, int(p)) for i, q in enumerate(queries) for p in np.flatnonzero(np.minimum(q, points).sum(axis=1) >= needed(q.sum(), sizes, 90))}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}


def test_rows_reach_python_in_small_batches(spark, tmp_path):
    """Wide rows went to Python 10,000 at a time; batches of a settled step have a bound in bytes, and the session keeps its setting."""
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["size"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    wide = spark.range(0, 4000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 8192) as x")
    got = [r.size for r in settle(wide.mapInArrow(sizes, "size bigint"), "sizes", jaccard_join.BATCH).collect()]
    assert sum(got) > 4000 * 8192 and max(got) < 1.5 * jaccard_join.BATCH
    assert spark.conf.get(key) == before


def test_points_of_a_pair_are_no_larger_than_needed():
    """A point went with 4,096 bytes, more than the set of most texts; the bound still tells unrelated sets apart."""
    rnd = np.random.default_rng(3)
    a, b = (rnd.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    p, q = (jaccard_join.points(h, np.zeros(len(h), np.int64), 1, jaccard_join.FINE)[0] for h in (a, b))
    assert len(jaccard_join._blob(p)) <= 1024
    assert np.minimum(p, q).sum() < needed(p.sum(), q.sum(), 80)
    assert np.minimum(p, p).sum() >= needed(p.sum(), p.sum(), 100)


@pytest.mark.parametrize("percent", [80, 90])
def test_empty_groups_name_no_cell(percent):
    """Unrelated sets met wherever the same group was empty in both: the largest cells, and pairs that grew as the square."""
    rnd = np.random.default_rng(4)
    sizes = rnd.integers(60, 900, 300)
    hashes, owner = rnd.integers(0, 1 << 62, sizes.sum()).astype(np.uint64), np.repeat(np.arange(len(sizes)), sizes)
    keys, who = cell_keys(hashes, owner, len(sizes), percent)
    held = np.unique(np.stack([keys, who.astype(np.uint64)]), axis=1)[0]
    assert np.unique(held, return_counts=True)[1].max() == 1
    assert len(np.unique(who)) == len(sizes)


def test_sets_that_fill_few_groups_keep_their_empty_ones():
    """Shingles that crowd into few groups leave none that must agree but the empty ones."""
    pool = np.arange(1, 200_000, dtype=np.uint64)
    groups = jaccard_join.group_counts(jaccard_join.classes(200), 80)[np.searchsorted(jaccard_join.classes(200), 100)]
    crowd = pool[jaccard_join.mix(pool ^ np.uint64(0xA5)) % np.uint64(groups) < 3]
    a, b = crowd[:100], np.r_[crowd[3:100], crowd[100:103]]
    keys, who = cell_keys(np.r_[a, b], np.r_[np.zeros(100, int), np.ones(100, int)], 2, 80)
    assert set(keys[who == 0]) & set(keys[who == 1])


def test_search_holds_few_pairs_at_a_time():
    """A block opened 256 queries against all points at once: 353 MB of a worker, and an executor over its limit."""
    import tracemalloc

    rnd = np.random.default_rng(5)
    points = rnd.poisson(2.0, 128) + (rnd.random((2048, 128)) < 0.02).astype(np.int32)
    tree = CountTree(points)
    tracemalloc.start()
    found = sum(len(q) for q, _ in tree.search(points[:512], 80))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 512 * 2048 and most < 64 << 20


def test_likely_keeps_all_that_are_asked_for(spark, monkeypatch):
    """Keys of either sign at every place of a byte, repeated rows and keys, no keys."""
    monkeypatch.setattr(jaccard_join, "BITS", 1 << 17)
    rows = spark.range(-4000, 4000).selectExpr("xxhash64(id) as at", "id").unionByName(spark.range(0, 64).selectExpr("id as at", "id")).unionByName(spark.range(0, 64).selectExpr("-id as at", "id"))
    keys = rows.filter("id % 40 = 0 or at between -64 and 64").select("at")
    got = jaccard_join.likely(rows, keys.unionByName(keys), "at")
    assert got.columns == rows.columns
    assert got.join(keys.distinct(), "at").count() == rows.join(keys.distinct(), "at").count()
    assert got.count() < 1.1 * keys.count() + 60
    assert jaccard_join.likely(rows, keys.limit(0), "at").count() == 0


def test_only_texts_that_stand_in_a_pair_are_shuffled(spark, monkeypatch):
    """Sets were made by a join that shuffled all texts, twice."""
    through, likely = [], jaccard_join.likely

    def told(df, keys, column):
        out = likely(df, keys, column)
        through.append((column, out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "likely", told)
    texts = [" ".join(say(60)) for _ in range(600)]
    docs = list(enumerate([*texts, *(t + " end" for t in texts[:6])]))
    got = component_ids(spark.createDataFrame(docs, "doc_id bigint, text string"), 3, 90).collect()
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id != r.component_id} == {(600 + i, i) for i in range(6)}
    assert [c for c, _ in through] == ["name", "at", "at"] and all(n <= 30 for _, n in through)
