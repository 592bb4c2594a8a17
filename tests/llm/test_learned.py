import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.llm import near_vectors, quality, toxicity
from tidebars.llm.quality import isotonic, statistics
from tidebars.llm.queries import fold
from tidebars.llm.textkit import flat_text

RND = random.Random(4)
VOCAB = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 8))) for _ in range(800)]
BAD = ["vermin", "rubbish", "fool"]


def say(n):
    return " ".join(RND.choice(VOCAB) for _ in range(n)).capitalize() + "."


def toxic_rows():
    out = [(None, say(9), 0), (100_000, None, None), (100_001, "", None), (100_002, "?!", None), (100_003, "fool " * 9000, None), (100_004, "Fool, fool", None)]
    for i in range(900):
        words, y = say(RND.randint(5, 80)).split(), int(i % 6 == 0)
        for _ in range(3 * y):
            words.insert(RND.randrange(len(words)), RND.choice(BAD))
        out.append((i, " ".join(words), y))
    return out + out[50:52]


ROWS = toxic_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, 1, "x") for d, t, _ in ROWS], "doc_id bigint, text string, y int, score string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(d, y, y) for d, _, y in ROWS if y is not None] + [(5, None, 1), (None, 1, 1)], "doc_id bigint, toxic int, quality int")


def test_toxicity_on_held_out(docs, labels):
    got = toxicity.score_documents(docs, labels, "toxic", fold(5) != 0).withColumn("out", fold(5) == 0).collect()
    assert len(got) == len(ROWS)
    truth = {d: y for d, _, y in ROWS}
    held = [r for r in got if r.out and r.doc_id is not None and truth[r.doc_id] is not None]
    assert len(held) > 100
    assert all((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held)
    by = {r.doc_id: r for r in got}
    assert by[100_000].score == by[100_001].score == by[100_002].score < 0.1
    assert by[100_003].score > 0.9 < by[100_004].score
    assert by[100_004].near_ids and by[100_004].near_cosines == sorted(by[100_004].near_cosines, reverse=True)


def test_toxic_rows_go_and_others_stay(docs, labels):
    kept = toxicity.without_toxic(docs, labels, "toxic", fold(5) != 0)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = [d for d, t, _ in ROWS if not set(BAD) & set((t or "").lower().replace(",", "").replace(".", "").split())]
    assert sorted(ids, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("often", [0, 7, 60])
@pytest.mark.parametrize("many", [0, 64])
def test_nearest_equal_all_cosines(monkeypatch, often, many):
    monkeypatch.setattr(toxicity, "OFTEN", often)
    monkeypatch.setattr(toxicity, "MANY", many)
    rnd = np.random.default_rng(0)
    idf = rnd.uniform(1, 5, 60)
    terms = [np.sort(rnd.choice(60, rnd.integers(1, 9), replace=False)) for _ in range(500)]
    counts = [rnd.integers(1, 5, len(t)) for t in terms]
    doc, label = np.arange(500) * 3, (np.arange(500) % 3 == 0).astype(float)
    index = toxicity.Index.build(np.arange(60, dtype=np.uint64), idf, doc, label, np.array([len(t) for t in terms]), np.concatenate(terms), np.concatenate(counts))
    assert sorted(index.doc[index.doc >= 0]) == doc.tolist()
    dense = np.zeros((len(index.doc), 60))
    for row, d in enumerate(index.doc):
        if d < 0:
            continue
        dense[row, terms[d // 3]] = index.vector(terms[d // 3], counts[d // 3])
    asked = [np.sort(rnd.choice(60, rnd.integers(1, 9), replace=False)) for _ in range(50)] + [np.zeros(0, np.int64)]
    queries = [(t, index.vector(t, np.ones(len(t)))) for t in asked]
    for but in (None, [int(d) for d in rnd.choice(doc, len(asked))]):
        for i, ((t, w), (near, found), (vote, *_)) in enumerate(zip(queries, index.nearest(queries, 15, but), index.votes([(t, np.ones(len(t))) for t in asked], 0.3, but))):
            cos = dense[:, t] @ w
            if but:
                cos[index.doc == but[i]] = 0
            want = np.lexsort((np.arange(len(cos)), -cos))[:15]
            want = want[cos[want] > 0]
            assert np.allclose(found, cos[want], atol=1e-6) and np.allclose(np.sort(cos[near]), np.sort(cos[want]), atol=1e-6)
            assert vote == pytest.approx((cos[near] ** 2 @ index.label[near] + 0.05 * 0.3) / ((cos[near] ** 2).sum() + 0.05), abs=1e-5)


def test_words_of_many_texts():
    import pyarrow as pa

    texts = ["Ab ab\u00a0cd", None, "", "x\u2014y «É» é\u3000z", "1a2", "é", "ab" * 9000]
    text, term, count = toxicity.terms_in(pa.array(texts))
    assert [sorted(count[text == i].tolist()) for i in range(7)] == [[1, 2], [], [], [1, 1, 1, 2], [1], [1], [1]]
    alone = [toxicity.terms_in(pa.array([t], pa.string())) for t in texts]
    assert [term[text == i].tolist() for i in range(7)] == [a[1].tolist() for a in alone]
    assert set(term[text == 5]) < set(term[text == 3])


def test_calibration_by_hand(spark, docs, labels):
    """Votes of the half that taught no weight, from brute-force neighbours, through the same step function."""
    judge = toxicity.learn_judge(docs, labels, "toxic", F.lit(True))
    index = judge.index.value
    dense = np.zeros((len(index.doc), len(index.vocabulary)))
    for t in range(len(index.vocabulary)):
        row, weight = index.parts(index.posting[index.start[t] : index.start[t + 1]])
        dense[row, t] = weight
    cos = dense @ dense.T
    np.fill_diagonal(cos, 0)
    cos[index.doc[:, None] == index.doc[None, :]] = 0
    votes = []
    for row in np.flatnonzero(~toxicity.half_of(index.doc) & (index.doc >= 0)):
        near = np.lexsort((np.arange(len(cos)), -cos[row]))[:15]
        near = near[cos[row][near] > 0]
        w = cos[row][near] ** 2
        votes.append(((w @ index.label[near] + 0.05 * judge.prior) / (w.sum() + 0.05), index.label[row]))
    v, y = np.array(sorted(votes)).T
    got = np.interp(v, judge.edges, judge.levels)
    assert (np.diff(got) >= 0).all()
    # A step function keeps totals: the levels of all votes add up to about the toxic ones.
    assert abs(got.sum() - y.sum()) < 0.1 * len(y) and ((got >= 0.5) == (y == 1)).mean() > 0.97


def test_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    assert {r.score for r in toxicity.score_documents(docs, none, "toxic", F.lit(True)).collect()} == {0.5}
    scored, _ = quality.score_documents(docs, none, "quality", F.lit(True))
    assert {r.score for r in scored.collect()} == {0.5}
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert toxicity.score_documents(empty, none, "toxic", F.lit(True)).count() == 0
    assert quality.score_documents(empty, none, "quality", F.lit(True))[0].count() == 0


def test_quality_on_held_out(spark):
    rows = [(None, "x", 1), (90_000, None, None), (90_001, "", None), (90_002, "word " * 30_000, None)]
    for i in range(800):
        y = int(i % 4 != 0)
        t = " ".join(say(8) for _ in range(RND.randint(1, 8)))
        rows.append((i, t if y else RND.choice([t.upper().replace(" ", "!! "), " ".join([RND.choice(VOCAB)] * 40), t.replace(" ", "### ")]), y))
    docs = spark.createDataFrame([(d, t, 0) for d, t, _ in rows], "doc_id bigint, text string, x int")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows if y is not None], "doc_id bigint, quality int")
    scored, _ = quality.score_documents(docs, labels, "quality", fold(4) != 2)
    got = scored.withColumn("out", fold(4) == 2).collect()
    assert len(got) == len(rows)
    truth = {d: y for d, _, y in rows}
    held = [r for r in got if r.out and truth.get(r.doc_id) is not None and r.doc_id is not None]
    assert sum((r.score >= 0.7) == bool(truth[r.doc_id]) for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_statistics_ignore_neighbours():
    import pyarrow as pa

    texts = ["One two two. | x!!", None, "", "a\nb", "ÄÖ 12"]
    together = statistics(*flat_text(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(together[i], statistics(*flat_text(pa.array([t], pa.string())))[0])


def test_isotonic_by_hand():
    centers, levels = isotonic(np.array([0.0, 1, 2, 3]), np.array([1000.0] * 4), np.array([0.0, 600, 400, 1000]))
    assert np.allclose(centers, [0, 1.5, 3]) and np.allclose(levels, [0, 0.5, 1], atol=0.001)


def vectors():
    rnd = np.random.default_rng(8)
    out = []
    for label in (0, 1, 2):
        base = rnd.normal(size=(250, 16))
        out += [(v.tolist(), label) for v in base]
        out += [((base[i] + rnd.normal(size=16) * 0.1).tolist(), label) for i in range(40)]
    crowd = rnd.normal(size=16)
    out += [((crowd + rnd.normal(size=16) * 0.12).tolist(), 1) for _ in range(400)]
    out += [(out[0][0], 0), (out[0][0], 0), (out[0][0], 1), (out[0][0], None), (out[1][0][:8], 0), ([x * 1e200 for x in out[2][0]], 0), ([0.0] * 16, 0), (None, 0), ([], 0)]
    out += [([1.0] * 15 + [x], 0) for x in (None, float("nan"), float("inf"))]
    return [(i * 2 + 7, v, label) for i, (v, label) in enumerate(out)]


def test_near_vectors_equal_all_pairs(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, label int, node int")
    got = {r.vec_id: r for r in near_vectors.near_groups(df).collect()}
    assert len(got) == len(rows)
    unit, parent = {}, {i: i for i, _, _ in rows}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            unit[i] = (label, x / np.linalg.norm(x))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = dict.fromkeys(parent, 0)
    ids = sorted(unit)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            (a, x), (b, y) = unit[i], unit[j]
            if a == b and len(x) == len(y) and x @ y >= 0.93:
                links[i] += 1
                links[j] += 1
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    true, hit = sum(links.values()), sum(min(links[i], got[i].n_links) for i in got)
    assert true > 1000 and hit == true
    assert all(got[i].n_links <= links[i] for i in got)
    assert all(got[i].component_id == find(i) for i in got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def bridged(labels=4, size=42):
    """Two dense groups a label; one pair between them links, three others fall just short of it."""
    rnd, out = np.random.default_rng(3), []
    for label in range(labels):
        e, f, *rest = np.linalg.qr(rnd.normal(size=(24, 24)))[0]
        turned = lambda degrees: np.cos(np.radians(degrees)) * e + np.sin(np.radians(degrees)) * f
        gap = np.degrees(np.arccos(0.931))
        short = [np.degrees(np.arccos(c)) - gap for c in (0.9290, 0.9294, 0.9298)]
        near, far = [turned(10), *(turned(10 - d) for d in short)], [turned(10 + gap)]
        for group, at in ((near, 0), (far, 20 + gap)):
            group += [turned(at) + 0.03 * (rnd.normal(size=22) @ np.array(rest)) for _ in range(size - len(group))]
        out += [(v.tolist(), label) for v in near + far]
    return [(i, v, label) for i, (v, label) in enumerate(out)]


def brute_groups(rows, least=0.93):
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([y for _, _, y in rows])
    close = (x @ x.T >= least) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(close, root[None, :], len(x)).min(axis=1))
        if (new == root).all():
            return close.sum(axis=1), root, close
        root = new


def test_single_links_between_dense_groups_are_found(spark):
    rows = bridged()
    links, root, close = brute_groups(rows)
    assert len(set(root.tolist())) == 4 and links.min() >= near_vectors.NEIGHBOURS
    assert all(close[84 * y : 84 * y + 42, 84 * y + 42 : 84 * y + 84].sum() == 1 for y in range(4))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in near_vectors.near_groups(df).collect()}
    assert [got[i].n_links for i in range(len(rows))] == links.tolist()
    assert [got[i].component_id for i in range(len(rows))] == root.tolist()


def test_all_links_of_a_label_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 50)
    rows = bridged(2)
    nodes = spark.createDataFrame([(i, y, 1, np.array(v).tobytes()) for i, v, y in rows], "node bigint, kind bigint, copies bigint, vector binary")
    roots = {r.node: r.root for r in near_vectors.components(near_vectors.all_links(nodes, 0.93)).collect()}
    assert [roots.get(i, i) for i in range(len(rows))] == brute_groups(rows)[1].tolist()


def test_audit_counts_vectors_whose_links_are_all_found(spark):
    rows = bridged(2)
    nodes = spark.createDataFrame([(i, y, 1, np.array(v).tobytes()) for i, v, y in rows], "node bigint, kind bigint, copies bigint, vector binary")
    split = spark.createDataFrame([(i, i // 42) for i, _, _ in rows], "node bigint, root bigint")
    assert near_vectors.audit(nodes, split, 0.93) == (168, 164)  # both ends of two links


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert near_vectors.near_groups(none).count() == 0
    bad = spark.createDataFrame([(1, None, 1), (2, [0.0], 1), (None, [1.0], 1)], "vec_id bigint, embedding array<float>, label int")
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in near_vectors.near_groups(bad).collect()) == [("1", 0, "1", True), ("2", 0, "2", True), ("None", 0, "None", False)]


def test_every_term_of_the_examples_counts(spark):
    # Two words in two of 40 toxic examples each: far below any floor of chi-square, but the only ones that tell.
    rare = [f"{a}{b}" for a in "qrstuvwxyz" for b in ("onk", "urp")]
    rows = [(i, f"{rare[i % 20]} plain talk here {VOCAB[300 + i // 20]}", 1) for i in range(40)] + [(100 + i, f"plain talk {w} here", 0) for i, w in enumerate(VOCAB[:200])]
    new = [(1000 + i, f"here {w} talk") for i, w in enumerate(rare)] + [(2000, "here talk plain"), (2001, "unheard")]
    docs = spark.createDataFrame([r[:2] for r in rows] + new, "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels, "toxic", F.lit(True)).collect()}
    for i in range(20):
        assert {i, i + 20} == set(got[1000 + i].near_ids[:2]) and got[1000 + i].score > 0.5
    assert len(got[2000].near_ids) == 15 and not got[2001].near_ids


def random_index(rnd, size, terms, each):
    sizes = rnd.integers(1, each, size)
    term = np.concatenate([np.sort(rnd.choice(terms, n, replace=False)) for n in sizes]).astype(np.int32)
    return np.arange(terms, dtype=np.uint64), rnd.uniform(1, 5, terms), np.arange(size) * 3, (np.arange(size) % 3 == 0).astype(float), sizes, term, rnd.integers(1, 400, len(term)).astype(np.uint16)


def test_index_is_built_in_runs(monkeypatch):
    """Runs of any length give the same index, and the driver holds few bytes a posting besides the index itself."""
    import tracemalloc

    given = random_index(np.random.default_rng(2), 300, 200, 50)
    whole = toxicity.Index.build(*given)
    assert np.array_equal(whole.vector(np.arange(9), np.arange(1, 10, dtype=np.uint8)), whole.vector(np.arange(9), np.arange(1, 10)))
    monkeypatch.setattr(toxicity, "RUN", 100)
    parts = toxicity.Index.build(*given)
    for name in ("doc", "label", "start", "posting"):
        assert np.array_equal(getattr(whole, name), getattr(parts, name))
    given = random_index(np.random.default_rng(3), 4000, 1000, 400)
    monkeypatch.setattr(toxicity, "RUN", 1 << 14)
    tracemalloc.start()
    toxicity.Index.build(*given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14 * len(given[5])


def test_coded_examples_travel_by_number(spark):
    """Five bytes a term reach the driver, not twelve; no term or count is lost."""
    texts = ["a b b c", "", "c " * 300 + "d", "x y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("y", F.lit(1))
    rows = toxicity.coded(docs)
    vocabulary = toxicity.vocabulary_of(rows)
    assert len(vocabulary) == 7 and (np.diff(vocabulary.astype(object)) > 0).all()
    got = {r.doc_id: r for r in toxicity.numbered(rows, spark.sparkContext.broadcast(vocabulary)).collect()}
    assert [len(got[i].terms) // 4 for i in range(4)] == [3, 0, 2, 3] and [len(got[i].counts) for i in range(4)] == [3, 0, 4, 3]
    for i, text in enumerate(texts):
        size = len(got[i].terms) // 4
        counts = toxicity.wide(bytes(got[i].counts), size)
        assert sorted(counts.tolist()) == sorted(text.split().count(w) for w in set(text.split()))
    number = [set(np.frombuffer(bytes(got[i].terms), np.int32).tolist()) for i in range(4)]
    assert len(number[0] & number[2]) == 1 and not number[3] & (number[0] | number[2])


def test_texts_reach_python_in_small_batches(spark, tmp_path, monkeypatch):
    """Texts went to Python 10,000 at a time, whatever their length, to be counted and judged."""
    slices, seen = toxicity.slices, str(tmp_path / "sizes")

    def noted(batch, *rest, **more):
        with open(seen, "a") as f:
            f.write(f"{batch.nbytes}\n")
        return slices(batch, *rest, **more)

    monkeypatch.setattr(toxicity, "slices", noted)
    docs = spark.range(0, 400, 1, 1).selectExpr("id as doc_id", "concat(repeat(if(id % 4 = 0, 'foul ', 'fair '), 8000), 'x', id) as text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 4 = 0) as toxic")
    kept = toxicity.without_toxic(docs, labels, "toxic", F.lit(True))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [i for i in range(400) if i % 4]
    with open(seen) as f:
        sizes = [int(x) for x in f]
    assert sum(sizes) > 2 * 400 * 40_000 and max(sizes) < 1.5 * toxicity.TERMS
