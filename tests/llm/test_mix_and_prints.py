import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidebars.llm import mixing, spotsigs
from tidebars.llm.textkit import shared_folder

RND = random.Random(5)
VOCAB = ["the", "of", "and", "de", "la", "und"] + ["".join(RND.choice("abcdefgh") for _ in range(5)) for _ in range(300)]


def say(n):
    return " ".join(RND.choice(VOCAB) for _ in range(n))


def rows():
    out = [(i, say(RND.randint(0, 120)), RND.choice(["b", "a", "hot", "hot", "hot", "é", "Z"])) for i in range(400)]
    out += [(400, None, "a"), (401, "", "a"), (402, " \n", None), (403, "x", None), (404, "###", "b"), (405, "### $$", "nothing"), (406, None, "empty"), (407, say(30_000), "a")]
    out += [(10, out[10][1], out[10][2]), (10, out[10][1], out[10][2]), (None, say(40), "a"), (None, say(40), "hot")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1.0, "x") for r in rows_], "doc_id bigint, text string, source string, target double, size string")


rows_ = rows()


def test_targets_by_hand():
    # 1.5 * 100 = 150, weights 3:1:2; "a" would get 75 of at most 20.
    assert mixing.targets({"a": 10, "b": 40, "c": 50}) == {"a": 20.0, "b": pytest.approx(130 / 3), "c": pytest.approx(260 / 3)}
    assert mixing.targets({}) == {}
    assert mixing.targets({"a": 0}) == {"a": 0.0}
    assert mixing.targets({None: 10, "z": 10})[None] == pytest.approx(10.0)


def test_mix_equals_plain_version(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_CELL", 20)
    got = mixing.mix_report(docs, shared_folder(spark, "mix")).collect()
    assert len(got) == len(rows_)
    keyed = mixing.sized(docs.select("doc_id", "text", "source")).select("doc_id", "source", "_mix.*").collect()
    by = defaultdict(list)
    for r in keyed:
        by[r.source].append(r)
    size = {s: sum(r.size for r in rs) for s, rs in by.items()}
    goal = mixing.targets(size)
    want = []
    for s, rs in by.items():
        epochs = int(goal[s] // size[s]) if size[s] else 0
        budget = goal[s] - epochs * size[s]
        groups = defaultdict(list)
        for r in rs:
            groups[r.key, r.row].append(r)
        best, total, chosen, order = budget, 0, 0, sorted(groups)
        for i, g in enumerate(order):
            total += sum(r.size for r in groups[g])
            if abs(total - budget) < best and budget > 0:
                best, chosen = abs(total - budget), i + 1
        for i, g in enumerate(order):
            want += [(r.doc_id, r["size"], size[s], round(goal[s], 6), r["size"] * (epochs + (i < chosen))) for r in groups[g]]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    # A stop after a document without words gives the same words as one before it.
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]


def test_mixed_rows(spark, docs):
    report = {(r.doc_id, r["size"]): r.taken for r in mixing.mix_report(docs, shared_folder(spark, "mix")).filter("doc_id > 10").collect()}
    out = mixing.mixed(docs, shared_folder(spark, "mix"))
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.filter("doc_id > 10").collect():
        words[r.doc_id] += len((r.text or "").split())
    assert {k[0]: v for k, v in report.items() if v} == {k: v for k, v in words.items() if v}


def test_weights_decide_the_draw(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.col("id")).alias("text"), F.lit("s").alias("source"))
    weighed = mixing.sized(df, F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).select("doc_id", "source", "_mix.*")
    first = weighed.orderBy("key").limit(500).filter("doc_id % 2 = 0").count()
    assert 360 < first < 440  # 4 in 5


def test_mixed_keeps_columns_of_any_name(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 2}", f"mine{i}", i * 0.5, i) for i in range(60)]
    names = ["doc_id", "text", "source", "_mix", "doc", "key"]
    df = spark.createDataFrame(rows, names)
    got = mixing.mixed(df, shared_folder(spark, "mix"))
    assert got.columns == names
    kept = {tuple(r) for r in got.collect()}
    assert kept and kept <= {tuple(r) for r in rows}


def test_empty_mix(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix_report(none, shared_folder(spark, "mix")).count() == 0


def test_edits_and_next(spark, docs):
    got = spotsigs.compare_edits(docs).collect()
    placed = sorted((d, t or "") for d, t, _ in rows_ if d is not None)
    want = defaultdict(list)
    for i, (d, t) in enumerate(placed):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + placed[(i + 1) % len(placed)][1][:cut]
        want[d].append((len(t), hashlib.sha256(edited.encode()).hexdigest()))
    have = defaultdict(list)
    for r in got:
        if r.doc_id is not None:
            have[r.doc_id].append((r.n_chars, r.edited_sha256))
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert {d: sorted(v) for d, v in want.items()} == {d: sorted(v) for d, v in have.items()}
    assert sum(r.doc_id is None for r in got) == 2
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[401] == prints[400] == prints[402] == "" != prints[404]
    long = [r for r in got if r.n_chars > 300]
    assert sum(r.near_edited > 0.3 for r in long) > 0.95 * len(long)
    assert sum(r.near_next < 0.2 for r in long) > 0.95 * len(long)
    twins = [r for r in got if r.doc_id == 10]
    assert sorted(r.near_next for r in twins)[1:] == [1.0, 1.0]


def test_no_rows(spark):
    assert spotsigs.compare_edits(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert spotsigs.compare_edits(spark.createDataFrame([(None, "a b c")], "doc_id bigint, text string")).count() == 1


def test_near_pairs_equal_all_pairs(spark):
    rnd = random.Random(2)
    sets = []
    for i in range(120):
        base = set(rnd.sample(range(200), rnd.randint(1, 40))) if i % 3 == 0 or not sets else set(sets[-1][1])
        sets.append((i, sorted(base - set(rnd.sample(sorted(base), len(base) // 15)) | {rnd.randint(0, 300)})))
    got = {(r.a, r.b): r.likeness for r in spotsigs.near_pairs(spark.createDataFrame(sets, "id int, signatures array<int>"), 0.8).collect()}
    distinct = {}
    for i, s in sets:
        distinct.setdefault(tuple(s), i)
    items = [(i, set(s)) for s, i in distinct.items()]
    want = {}
    for n, (a, x) in enumerate(items):
        for b, y in items[n + 1 :]:
            j = len(x & y) / len(x | y)
            if j >= 0.8 and math.isfinite(j):
                want[min(a, b), max(a, b)] = j
    assert got == want


def test_native_plan(spark, docs):
    plan = spotsigs.compare_edits(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_one_rule_for_texts_and_runs_of_all_lengths(spark):
    rnd, pairs = random.Random(9), []
    word = lambda: "".join(rnd.choice("bcdfghklm") for _ in range(6))
    for i in range(20):  # near copies on either side of 400 characters
        words = ["the" if j % 7 == 0 else word() for j in range(62)]
        pairs.append((" ".join(words), " ".join(words[:56])))
    for i in range(20):  # runs between anchors of about 75 and 85 characters in long texts
        runs = [[word() for _ in range(11)] for _ in range(12)]
        pairs.append((" the ".join(" ".join(r) for r in runs), " the ".join(" ".join(r + [word()]) for r in runs)))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    df = spotsigs.with_signatures(spotsigs.with_signatures(df, "a", "sa"), "b", "sb")
    got = {r.i: r for r in df.select("i", "sa", "sb", spotsigs.likeness(F.col("sa"), F.col("sb")).alias("near")).collect()}
    assert all(len(a) > 400 > len(b) for a, b in pairs[:20]) and all(len(a) > 400 for a, _ in pairs[20:])
    assert sum(got[i].near for i in range(20)) / 20 > 0.75
    assert sum(got[i].near for i in range(20, 40)) / 20 > 0.6
    assert all(set(got[i].sb) & set(got[i].sa) for i in got)
    bare = spark.createDataFrame([("zebra",), ("zebra qux",), ("",)], "t string")
    assert [len(r.s) for r in spotsigs.with_signatures(bare, "t", "s").collect()][::2] == [1, 0]
