import hashlib
import random
from collections import Counter

import pytest

from tidebars.llm import substring_sort, substring_tree
from tidebars.llm.substring_sort import merge, repeated_shifts, shared_prefix


def removed_words(rows, window):
    """The definition, by a dictionary of all windows."""
    first, texts = {}, [(d, (t or "").encode().split()) for d, t in rows]
    rank = lambda d: 2**63 - 1 if d is None else d
    for d, w in texts:
        for i in range(len(w) - window + 1):
            s = tuple(w[i : i + window])
            first[s] = min(first.get(s, rank(d)), rank(d))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < rank(d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def removed_bytes(rows, window):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + window] for _, b in texts for i in range(len(b) - window + 1))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def texts(seed, n):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6))) for _ in range(40)]
    say = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    passages = [say(rnd.randint(10, 90)) for _ in range(6)]
    out = [None, "", "  \n\t ", "one", say(12), say(13), say(13), "go " * 700, "go " * 650, "x" * 1000, "y" * 199, "z" * 200, "z" * 200, say(9000)]
    for _ in range(n):
        t = say(rnd.randint(0, 150))
        for _ in range(rnd.randint(0, 3)):
            t += rnd.choice([" ", "\n", "  "]) + rnd.choice(passages) + " " + say(rnd.randint(0, 20))
        out.append(t)
    out += rnd.choices(out, k=n // 3)
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, t) for i, t in enumerate(texts(3, 120))]
    out += [(None, out[20][1]), (None, out[21][1]), (5, out[30][1]), (5, out[30][1]), (40, out[40][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id bigint, text string, rk int, bucket string")


@pytest.mark.parametrize("window,hot", [(13, 20_000), (13, 2), (5, 20_000)])
def test_words_equal_brute_force(docs, rows, window, hot):
    key = lambda r: (r[0] is None, *(r[:1] if r[0] is not None else (0,)), *r[1:])
    got = sorted(map(tuple, substring_tree.remove_repeats(docs, window, hot).collect()), key=key)
    assert got == sorted(removed_words(rows, window), key=key)


@pytest.mark.parametrize("window,hot", [(200, 20_000), (200, 2), (40, 20_000)])
def test_bytes_equal_brute_force(docs, rows, window, hot):
    key = lambda r: (r[0] is None, *(r[:1] if r[0] is not None else (0,)), *r[1:])
    got = sorted(map(tuple, substring_sort.remove_repeats(docs, window, hot).collect()), key=key)
    assert got == sorted(removed_bytes(rows, window), key=key)


def test_remaining_texts(docs, rows):
    left = substring_sort.without_repeats(docs)
    assert left.columns == docs.columns
    got = Counter((r.doc_id, len((r.text or "").encode())) for r in left.collect())
    want = Counter((d, n - gone) for d, n, gone, _, _ in removed_bytes(rows, 200))
    assert sum(got.values()) == len(rows)
    # Only where a cut goes through a letter may a byte or so less remain.
    assert sum((got & want).values()) > 0.8 * len(rows)
    assert [r.text for r in left.filter("doc_id = 0").collect()] == [None]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert substring_tree.remove_repeats(none).count() == 0
    assert substring_sort.remove_repeats(none).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_loser_tree_sorts(seed):
    rnd = random.Random(seed)
    runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(1, 7))]
    coded = []
    for run in runs:
        last, out = b"", []
        for s in run:
            n = shared_prefix(last, s)
            out.append((n, s[n:]))
            last = s
        coded.append(iter(out))
    got = list(merge(coded))
    assert [k for _, _, k in got] == sorted(s for run in runs for s in run)
    for (_, _, a), (n, _, b) in zip(got, got[1:]):
        assert n == shared_prefix(a, b)


@pytest.mark.parametrize("seed", range(10))
def test_both_ways_to_find_shifts(seed, monkeypatch):
    rnd = random.Random(seed)
    window = 12
    pool = ["".join(rnd.choice("ab") for _ in range(10)) for _ in range(5)]
    rows = {("abab" + rnd.choice(pool)[: rnd.randint(2, 8)], rnd.choice(pool)[: rnd.randint(4, 8)]) for _ in range(40)}
    rows = sorted(((r + s).encode(), len(r), len(s)) for r, s in rows if len(r) + len(s) >= window)
    common = [0] + [shared_prefix(a[0], b[0]) for a, b in zip(rows, rows[1:])]
    copies = [rnd.choice((1, 1, 2)) for _ in rows]
    args = ([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], common, copies, window)
    sets = []
    for most in (10_000, 0):
        monkeypatch.setattr(substring_sort, "PAIRS_UP_TO", most)
        sets.append([{x for lo, hi in spans for x in range(lo, hi + 1)} for spans in repeated_shifts(*args)])
    assert sets[0] == sets[1]
