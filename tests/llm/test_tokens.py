import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tidebars.llm import bpe, token_counts

RND = random.Random(7)
TEXTS = [
    None, "", " ", "   ", "\n \n  x", "a", "the cat's hat, they'll 12 3,4!", "a<|endoftext|>b  <|endoftext|> ", "aaaa" * 50, "!" * 301,
    "naïve 漢字 ٣٤ ՘՘  em", "".join(RND.choice("abcde  \n\té漢1'ts.") for _ in range(3000)), "".join(RND.choice("abcdefgh") for _ in range(5000)),
    "same text", "same text", "x " * 4000, "trailing ", " leading", "two  spaces", "tab\t and\n  mixed \n ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "text-like", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, `n tokens` int")


def test_bpe_equals_the_library(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encode_texts(docs, path).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want
        assert got[i].decoded == lib.decode(want, skip_special_tokens=False)


def test_bpe_digests(docs):
    import hashlib

    import numpy as np

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for r in bpe.encode_digests(docs, path).collect():
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_heap_equals_rounds():
    b = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    for n in (1, 2, 50, 900):
        word = bytes(RND.choice(b"abcdeth ing") for _ in range(n))
        assert b.merge_long(word).tolist() == b.merge_words([word])[0].tolist()


def test_counts_equal_the_library(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = Tokenizer(models.Unigram(token_counts.read_pieces(path), unk_id=0, byte_fallback=True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == len(lib.encode(t or "", add_special_tokens=False).ids), i


def test_count_ties():
    # Both paths of "abc" score -3; the longer last piece wins, as in the library.
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -1.0), ("bc", -1.0), ("abc", -2.0)]
    lib = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    own = token_counts.Unigram(pieces)
    for t in ("abc", "ab", "abcabc", "aabbcc", "cab bca", "abcb"):
        assert own.count_text(t) == len(lib.encode(t).ids), t


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode_digests(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert token_counts.count_tokens(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_cache_is_small_and_emptied_between_texts():
    """A worker kept up to a million words, 230 MB; what a cache forgets is learned again with the same ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, b = Tokenizer.from_file(path), bpe.ByteBpe(path)
    rnd = random.Random(3)
    first = " ".join(rnd.choice(["the", "cat", "naïve", "12"]) + hex(rnd.getrandbits(32)) for _ in range(2_000))
    want = lib.encode(first, add_special_tokens=False).ids
    assert b.encode([first])[0].tolist() == want
    for _ in range(8):
        b.encode([" ".join(hex(rnd.getrandbits(20)) + "z" + str(n) for n in range(40_000))])
    assert len(b.rows) < bpe.CACHE_WORDS + 50_000 <= 320_000
    assert b.encode([first])[0].tolist() == want


def test_cache_of_long_words_is_small(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1 << 19, raising=False)
    b, rnd = bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    for _ in range(12):
        b.encode([hex(rnd.getrandbits(400_000))])
    assert sum(map(len, b.rows)) < 1 << 20


def test_digests_send_texts_in_small_batches(spark, monkeypatch):
    """Texts went to Python 10,000 at a time, whatever their length."""
    sent, settle = [], bpe.settle
    monkeypatch.setattr(bpe, "settle", lambda df, name, batch=None: sent.append(batch) or settle(df, name, batch))
    wide = spark.range(0, 40, 1, 1).selectExpr("id as doc_id", "repeat('word ', 40000) as text")
    assert bpe.encode_digests(wide, public_tokenizers.path("byte_bpe_50k.json")).count() == 40
    assert sent == [bpe.BATCH]
