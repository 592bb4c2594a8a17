"""Byte-level BPE: texts to ids and back.

The merge loop works on a flat array that holds the symbols of many words.  In
each round every word merges all places of its lowest-ranked pair; ranks are
found by binary search over sorted pair keys and looked up again only beside
what changed.  Ids and decoded text are those of the tokenizers library.

A null or empty text has no ids and decodes to empty text.  Repeated rows give
repeated results.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.textkit import settle, slices, spread

#: Fixed: the split pattern of this family of tokenizers, white space spelt out.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed: letters and digits of Unicode versions later than the tokenizers library's; it takes them for symbols.
LATER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    r"\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    r"\U00011b0a-\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1-\U00011df1\U0001246f-\U0001246f"
    r"\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168-\U0001b168\U0001d6a6-\U0001d6a6\U0001df1f-\U0001df24"
    r"\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    r"\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f"
    r"\U0002b81e-\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d|\x20?[\p{{L}}--[{LATER}]]+|\x20?[\p{{N}}--[{LATER}]]+"
    rf"|\x20?[[^{SPACE}\p{{L}}\p{{N}}][{LATER}]]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: A split before a space is a split of the pattern too, but where white space stands on both sides of it.
UNSAFE = rf"[{SPACE}]\x20(?:[{SPACE}]|\Z)"
NONE = np.int64(1 << 40)
LONG_WORD = 2048
#: Marks the key of a special token; two spaces start no other key.
SPECIAL = "  "
#: A worker's cache is emptied beyond so many words, or so many characters and bytes of ids: unusual words seldom come again.
CACHE_WORDS = 1 << 18
CACHE_BYTES = 16 << 20
#: Texts go to Python so many bytes at a time.
BATCH = 4 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (chr(256 + i) for i in range(256))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


class ByteBpe:
    """Vocabulary and merges of one file, with a bounded cache of encoded words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = dict(spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        pieces = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            pieces[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.find = regex.compile(PATTERN, regex.V1).findall
        self.unsafe = re.compile(UNSAFE).search
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._empty_cache()

    def _empty_cache(self) -> None:
        self.rows: dict[str, int] = {}
        self.held = 0
        self.ids = np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)
        self._add([SPECIAL + t for t in self.special], [np.array([i], np.int32) for i in self.special.values()])

    def _add(self, words: list[str], coded: list[np.ndarray]) -> None:
        sizes = np.array([len(c) for c in coded], np.int64)
        self._append(words, np.concatenate([np.zeros(0, np.int32), *coded]), sizes)

    def _append(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        base = len(self.at)
        self.rows.update(zip(words, range(base, base + len(words))))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(sizes) - sizes])
        self.len = np.concatenate([self.len, sizes])
        self.ids = np.concatenate([self.ids, flat.astype(np.int32)])
        self.held += sum(map(len, words)) + 4 * len(flat)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), at

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words and the number of ids of each."""
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        rank, at = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], at[inner] = self._rank(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            runs = np.diff(np.r_[first, len(word)])
            least = np.minimum.reduceat(rank, first)
            live = np.repeat(least < NONE, runs)
            if not live.all():
                done.append((word[~live], sym[~live]))
                least = np.repeat(least, runs)[live]
                sym, word, rank, at = sym[live], word[live], rank[live], at[live]
                if not len(sym):
                    break
            else:
                least = np.repeat(least, runs)
            hit = rank == least
            index = np.arange(len(sym))
            # Of overlapping places (a run of one symbol) every other one merges.
            begin = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], index, 0))
            hit &= (index - begin) % 2 == 0
            where = np.flatnonzero(hit)
            sym[where] = self.merged[at[where]]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            now = np.cumsum(keep)[where] - 1
            sym, word, rank, at = sym[keep], word[keep], rank[keep], at[keep]
            beside = np.zeros(len(sym), bool)
            beside[now] = beside[np.maximum(now - 1, 0)] = True
            rank[beside] = NONE
            touched = np.flatnonzero(beside[:-1] & (word[:-1] == word[1:]))
            rank[touched], at[touched] = self._rank(sym[touched], sym[touched + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word = np.concatenate([d[0] for d in done])
        order = np.argsort(word, kind="stable")
        return np.concatenate([d[1] for d in done])[order], np.bincount(word, minlength=len(words))

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same for one very long word: a heap of pairs over a linked list, n log n."""
        sym = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(sym)
        nxt, prv, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        rank, at = self._rank(np.array(sym[:-1], np.int64), np.array(sym[1:], np.int64))
        heap = [(r, i, sym[i], sym[i + 1], int(self.merged[a])) for i, (r, a) in enumerate(zip(rank.tolist(), at.tolist())) if r < NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], nxt[i] = new, False, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for k in (prv[i], i):
                if k >= 0 and nxt[k] >= 0:
                    r, x = self._rank(np.array([sym[k]]), np.array([sym[nxt[k]]]))
                    if r[0] < NONE:
                        heapq.heappush(heap, (int(r[0]), k, sym[k], sym[nxt[k]], int(self.merged[x[0]])))
        return np.array([s for s, ok in zip(sym, alive) if ok], np.int32)

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks that are not in the cache; a chunk is what stands between two spaces, see chunks_of."""
        pieces, counts = [], []
        for c in chunks:
            found = self.find(c[1:] if c[:1] == " " else " " + c)
            pieces += found
            counts.append(len(found))
        raw = [p.encode() for p in pieces]
        long = [i for i, r in enumerate(raw) if len(r) > LONG_WORD]
        solved = [self.merge_long(raw[i]) for i in long]
        for i in long:
            raw[i] = b""
        flat, sizes = self.merge_words(raw)
        ends = np.cumsum(sizes)
        if long:
            flat = np.insert(flat, np.repeat(ends[long] - sizes[long], [len(x) for x in solved]), np.concatenate(solved))
            sizes[long] = [len(x) for x in solved]
            ends = np.cumsum(sizes)
        stops = np.r_[0, ends][np.cumsum(counts)] if counts else np.zeros(0, np.int64)
        self._append(chunks, flat, np.diff(np.r_[0, stops]))

    def chunks_of(self, text: str) -> list[str]:
        """Keys of a text's chunks: "w" stands for a space and w, " w" for w without one before it."""
        if not text:
            return []
        if self.unsafe(text):
            return [w[1:] if w[0] == " " and " " not in w[1:] and len(w) > 1 else " " + w for w in self.find(text)]
        first, *rest = text.split(" ")
        return [" " + first, *rest] if first else rest

    def words_of(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.chunks_of(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [SPECIAL + part] if part in self.special else self.chunks_of(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and len + 1 offsets."""
        if len(self.rows) > CACHE_WORDS or self.held > CACHE_BYTES:
            self._empty_cache()
        each = [self.words_of(t) for t in texts]
        words = [w for ws in each for w in ws]
        missing = [w for w in dict.fromkeys(words) if w not in self.rows]
        if missing:
            self._learn(missing)
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        sizes = self.len[rows]
        ids = self.ids[spread(self.at[rows], sizes)]
        ends = np.r_[0, np.cumsum(sizes)]
        return ids, ends[np.r_[0, np.cumsum([len(ws) for ws in each])].astype(np.int64)]

    def decode_bytes(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where each id ends."""
        sizes = self.piece_len[ids]
        return self.piece_bytes[spread(self.piece_at[ids], sizes)].tobytes(), np.cumsum(sizes)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids)[0].decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode_texts(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, ids array<int> and decoded string for every row of df."""
    schema = ", ".join(f"`{df.schema[c].name}` {df.schema[c].dataType.simpleString()}" for c in keep)
    names = [f"_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch):
                ids, ends = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                decoded = [bpe.decode(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists, pa.array(decoded, pa.string())], [*keep, "ids", "decoded"])

    cols = [F.col(c).alias(n) for c, n in zip(keep, names)]
    return df.select(*cols, F.col(text).alias("text")).mapInArrow(run, f"{schema}, ids array<int>, decoded string")


def encode_digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of df(doc_id, text).

    Stored once, so that texts reach Python in small batches whoever reads the digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch):
                ids, ends = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                raw, stops = bpe.decode_bytes(ids)
                stops = np.r_[0, stops][ends]
                packed = ids.astype("<u4").tobytes()
                sha_ids = [hashlib.sha256(packed[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])]
                sha_text = [hashlib.sha256(raw[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(stops[:-1], stops[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(sha_ids, pa.string()), pa.array(sha_text, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    digests = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return settle(digests, "digests", BATCH)
