"""Phrase index, automaton scan and Merkle manifest against brute force, and the odd cases."""

import math
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.llm import lexical_scan, merkle, phrase_index

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, vocabulary=40):
    return " ".join(f"w{int(x)}" for x in (rng.pareto(1.0, n) * 3).clip(0, vocabulary))


def documents(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name, value in more.items():
        df = df.withColumn(name, value)
    return df


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    passages = [prose(rng, n, 400) for n in (10, 14, 40, 9, 3, 25)]
    texts = [prose(rng, int(n), 400) for n in rng.integers(0, 120, 120)]
    for i in range(0, 120, 4):
        p = passages[i // 4 % len(passages)].split()
        texts[i] += " | " + " -- ".join(p[: len(p) - i % 3]).upper() + " end"
    texts += [None, "", "...", texts[3], "É " + texts[0], "x" * 50_000, prose(rng, 20_000, 400)]
    return texts, [*enumerate(passages), (6, None), (7, ""), (8, "w1"), (9, "w1 w1"), (9, "w0 w2 w0"), (None, passages[2])]


def split(text, pattern=phrase_index.WORDS):
    return re.findall(pattern, (text or "").translate(AZ))


def brute_hits(text, bench, width=10):
    words = split(text)
    hit, ids = set(), set()
    for item, t in bench:
        w = split(t)
        n = min(width, len(w))
        for s in range(len(w) - n + 1) if n else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[s : s + n]:
                    hit.update(range(i, i + n))
                    ids |= {str(item)} if item is not None else set()
    return len(words), len(hit), len(ids), sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_contamination(spark, corpus):
    texts, bench = corpus
    docs = documents(spark, texts, words=F.lit(1), item=F.lit("x"), rk=F.lit(2))
    got = {r.doc_id: tuple(r)[1:] for r in phrase_index.contamination(docs, items(spark, bench)).collect()}
    assert got == {i: brute_hits(t, bench) for i, t in enumerate(texts)}


def test_contamination_without_broadcast(spark, corpus, monkeypatch):
    texts, bench = corpus
    monkeypatch.setattr(phrase_index, "MOST_ROWS", 0)
    got = {r.doc_id: tuple(r)[1:] for r in phrase_index.contamination(documents(spark, texts[:60]), items(spark, bench)).collect()}
    assert got == {i: brute_hits(t, bench) for i, t in enumerate(texts[:60])}


def test_phrase_plan_is_native(spark, corpus):
    texts, bench = corpus
    plan = phrase_index.contamination(documents(spark, texts).filter("doc_id < 9"), items(spark, bench))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_near_matches(spark, corpus):
    texts, bench = corpus
    # Documents with the words of a passage out of order, with a word between, and too far apart.
    p = split(bench[2][1])[:10]
    texts = [" ".join(reversed(p)), " ".join(w for x in p for w in (x, "zz")), " ".join(w for x in p for w in (x, *["zz"] * 9)), *texts[:30]]
    bench = [(2, " ".join(p)), (5, bench[5][1]), (4, bench[4][1])]
    docs = documents(spark, texts)
    own, places = phrase_index.items_of(items(spark, bench))
    index = phrase_index.positional_index(docs, places)
    ids = index.select("rk", "doc_id").distinct()
    for span in (10, 20):
        rows = phrase_index.near_matches(index, own, places, span).join(ids, "rk").join(own.select("item", "item_id"), "item").collect()
        got = {(r.doc_id, int(r.item_id), r.start) for r in rows}
        want = set()
        for i, t in enumerate(texts):
            words = split(t)
            for item, text in bench:
                w = split(text)
                n = min(10, len(w))
                for s in range(len(w) - n + 1):
                    if any(set(w[s : s + n]) <= set(words[a : a + span]) for a in range(len(words))):
                        want.add((i, item, s))
        assert got == want
        best = {}
        for r in rows:
            key = (r.doc_id, int(r.item_id), r.start)
            w, words = split(dict(bench)[key[1]]), split(texts[r.doc_id])
            held = set(w[r.start : r.start + min(10, len(w))])
            assert held <= set(words[r["first"] : r["last"] + 1]) and r["last"] - r["first"] < span
            best[key] = (held, words, min(best.get(key, (0, 0, span))[2], r["last"] - r["first"]))
        # The shortest stretch of all holds a place of the rarest term.
        assert not any(held <= set(words[a : a + shortest]) for held, words, shortest in best.values() for a in range(len(words)))


def test_empty_tables(spark):
    none, one = documents(spark, ["a b"]).filter("false"), documents(spark, ["a b", None])
    bench = items(spark, [(1, "a b")])
    assert phrase_index.contamination(none, bench).count() == 0
    assert [r.n_hit for r in phrase_index.contamination(one, bench.filter("false")).orderBy("doc_id").collect()] == [0, 0]
    assert lexical_scan.rank(none, bench).count() == lexical_scan.rank(one, bench.filter("false")).count() == 0
    assert merkle.manifest(none, F.lit(True), unbroken).count() == 0


TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def brute_rank(texts, bench, k=20):
    docs = [(i, [w.translate(AZ) for w in re.findall(TERMS, t or "")]) for i, t in texts]
    docs = [(i, w, {x: w.count(x) for x in set(w)}) for i, w in docs if w]
    total, length = len(docs), sum(len(w) for _, w, _ in docs)
    df = {}
    for _, _, tf in docs:
        for x in tf:
            df[x] = df.get(x, 0) + 1
    out = []
    for n, (item, text) in enumerate(bench):
        scored = []
        for i, w, tf in docs:
            m = 75 + 25 * len(w) * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m)) for x in (y.translate(AZ) for y in re.findall(TERMS, text or "")) if x in tf)
            if s > 0:
                scored.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_rank(spark, corpus, monkeypatch):
    texts, bench = corpus
    texts = [*enumerate([*texts[:90], *texts[:20], "W1 w1-w1 Éa éa Ñ", "Ñ", *texts[120:]])]
    texts += texts[:3]  # repeated rows
    bench = [*bench[:9], (10, "éa Éa ñ Ñ w1"), (11, "nowhere")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("n", F.lit(1))
    ranked = lambda: sorted((tuple(r) for r in lexical_scan.rank(df, items(spark, bench)).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    want = brute_rank(texts, bench)
    assert ranked() == want
    monkeypatch.setattr(lexical_scan, "CELLS", 64)
    assert ranked() == want
    monkeypatch.setattr(lexical_scan, "BLOCK_BYTES", 600)
    assert ranked() == want


def brute_manifest(rows, fanout=3):
    """rows: (doc_id, source, leaf, given)."""
    H = lambda *x: sha256("".join(x).encode()).hexdigest()

    def climb(nodes):
        paths = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for leaf, i in enumerate(at):
                first = i - i % fanout
                paths[leaf].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + fanout])))
                at[leaf] = i // fanout
            nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        return nodes[0], paths

    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(r[1], []).append(r)
    lower = [climb([r[2] for r in g]) for g in groups.values()]
    root, upper = climb([s for s, _ in lower])
    out = []
    for (sub, paths), above, g in zip(lower, upper, groups.values()):
        for r, path in zip(g, paths):
            node = r[3]
            for a, b in path + above:
                node = H(a, node, b)
            out.append((r[0], r[2], sub, root, H(*(a + b for a, b in path + above)), node, node == root))
    return sorted(out, key=str)


def unbroken(text):
    return text.replace("\n", "")


def brute_leaf(*values):
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


@pytest.mark.parametrize("levels", [0, 2, 6])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng = np.random.default_rng(levels)
    sizes = {"a": 1, "é": 2, None: 4, "": 9, "Z": 28, "z": 90, "b c": 3, "q": 10, "r": 27, "s": 5}
    rows = [(int(rng.integers(0, 10**9)), f"line\n{s}\n" * int(rng.integers(0, 3)), "en", s, int(n)) for s, size in sizes.items() for n in range(size)]
    rows += [rows[0], rows[40], rows[40], (None, None, None, "Z", None), (7, None, "é", None, 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit("x")).withColumn("at", F.lit(3)).repartition(5)
    tampered = lambda d: d is not None and crc32(str(d).encode()) % 2 == 0
    leaves = [(d, s, brute_leaf(d, s, l, n, t), brute_leaf(d, s, l, n, t.replace("\n", "") if t is not None and tampered(d) else t)) for d, t, l, s, n in rows]
    got = merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 2 == 0, unbroken)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.columns == names
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_manifest(leaves)


def test_manifest_of_one(spark):
    row = merkle.manifest(documents(spark, ["a\nb"]), F.lit(True), unbroken).first()
    assert row.leaf == row.subroot == row.root == brute_leaf(0, "s0", "en", 3, "a\nb")
    assert row.proof_sha256 == sha256(b"").hexdigest() and not row.verified and row.folded_root == brute_leaf(0, "s0", "en", 3, "ab")
