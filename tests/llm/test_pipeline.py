import random
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_jaccard import brute
from tests.llm.test_repeats import removed_bytes
from tidebars.llm import mixing

RND = random.Random(21)
VOCAB = ["".join(RND.choice("abcdefghijklm") for _ in range(RND.randint(2, 8))) for _ in range(900)]
BAD = ["vermin", "rubbish", "fool"]


def say(n):
    return " ".join(RND.choice(VOCAB) for _ in range(n))


def corpus():
    passage = say(60)
    rows = [(900, None, "en", "a", 0), (901, "", "en", None, 0), (902, " \n", None, "b", 2), (903, say(4000), "en", "b", None)]
    for i in range(400):
        t = say(RND.randint(20, 90))
        if i % 5 == 0:
            t += " " + " ".join(RND.choices(BAD, k=3))
        if i % 11 == 1:
            t += "\n" + passage + " " + say(5)
        rows.append((i, t, "en", RND.choice(["a", "a", "b", "c"]), len(t)))
    for i, k in ((500, 1), (501, 1), (502, 6), (503, 7)):
        words = rows[4 + k][1].split(" ")
        words[3] = "changed" if i % 2 else words[3]
        rows.append((i, " ".join(words), "en", "c", 1))
    return rows + [rows[9]]


def test_every_stage_against_its_definition(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 1, int(any(w in BAD for w in (r[1] or "").split()))) for r in rows if r[0] < 400]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    now, names = [tuple(r) for r in docs.collect()], [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "repeats", "mixing", "encoding"]
    for name, stage in corpus_pipeline.STAGES:
        frame = spark.createDataFrame(now, docs.schema)
        out = stage(spark, frame, str(tmp_path))
        got = [tuple(r) for r in out.collect()]
        if name != "encoding":
            assert out.columns == docs.columns
        if name == "toxicity":
            assert Counter(got) == Counter(r for r in now if not any(w in BAD for w in (r[1] or "").split()))
        elif name == "near_copies":
            part = brute([r[:2] for r in now], 5, 80)
            words = [d for d, n, _ in part if n]
            assert Counter(r[0] for r in got) == Counter({c for _, n, c in part if n}) + Counter(d for d, n, _ in part if not n)
            assert len(words) > len({c for _, n, c in part if n})
            assert set(got) <= set(now)
        elif name == "repeats":
            want = {d: n - gone for d, n, gone, _, _ in removed_bytes([r[:2] for r in now], 200)}
            assert {r[0]: len((r[1] or "").encode()) for r in got} == want
            assert sum(want.values()) < sum(len((r[1] or "").encode()) for r in now)
            assert all(r[4] is None if r[1] is None else r[4] == len(r[1]) for r in got)
        elif name == "mixing":
            size = defaultdict(int)
            for r in now:
                size[r[3]] += len((r[1] or "").split())
            goal, have, times = mixing.targets(size), defaultdict(int), Counter(got)
            longest = max(len((r[1] or "").split()) for r in now)
            for r, n in times.items():
                assert r in now and n <= 2
                have[r[3]] += n * len((r[1] or "").split())
            assert all(abs(have[s] - goal[s]) <= longest for s in size)
        else:
            lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert Counter(r[:2] for r in got) == Counter((r[0], len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in now)
        now = got if name != "encoding" else now


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
