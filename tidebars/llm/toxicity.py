"""Toxicity by nearest labelled examples: exact TF-IDF cosine through an inverted index with block maxima.

Terms are words (runs of letters, case aside), as 64-bit hashes.  Letters are a-z and
all above ASCII but for the punctuation of U+0080-00BF, U+2000-207F and U+3000-303F.
All terms of a bounded sample of labelled documents are indexed; none is left out.
A weight is (1 + ln tf) times the inverse document frequency, counted over all
documents, times one plus the root of the term's chi-square with the label.  To
calibrate, the chi-square is taken from one half of the examples and the votes of the
other half are compared with their labels; documents are then judged with weights from
all examples.  Lengths of vectors are over the terms of the examples.

Examples lie in blocks.  The postings of rarer terms are added up; the OFTEN most
frequent terms have block maxima, which bound what they can add to any example of a
block, and only examples whose bound reaches the k-th neighbour are completed.  Where
very many remain, the texts of a batch are completed together.  Neighbours are exact.
Votes weigh with cosine; a step function fitted on leave-one-out votes turns them
into probabilities.

A document that shares no term with an example has no neighbours and gets the
smoothed share of toxic examples among those whose own votes are not over the prior.
Null text is empty.
Without examples of both kinds every score is the smoothed share of the label.
Repeated rows give repeated results; a document with two labels is an example for
each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.quality import isotonic
from tidebars.llm.textkit import Rolling, byte_values, flat_text, give_back, settle, shuffle_partitions, slices, small_batches, spread

#: At most so many examples of each label are learned from (those with the least hashes of their ids).
MOST_TOXIC, MOST_CLEAN = 8192, 16384
NEIGHBOURS = 15
BLOCK = 8
#: So many of the terms that most examples hold have block maxima instead of postings.
OFTEN = 512
#: Blocks completed first, to learn what the k-th neighbour must reach; texts with more than MANY left are completed together.
FIRST, MANY = 8, 16
#: Texts looked at together.
BATCH = 128
#: Bytes of text whose terms are made together.
SLICE = 1 << 18
#: Rounding of single precision, in bounds and products of unit vectors.
ROUNDING = 1e-5
PRIOR_VOTES = 0.05
#: Counts of so many terms travel as one row.
CHUNK = 1 << 14
#: The driver works on about so many postings at a time; texts and terms go to Python TERMS bytes at a time, a vocabulary travels in pieces of as many.
RUN = 1 << 19
TERMS = 4 << 20

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and text of every word of lower-cased texts."""
    inside = np.r_[_LETTER[raw], False]
    for lead, low, high, size in ((0xC2, 0x80, 0xBF, 2), (0xE2, 0x80, 0x81, 3), (0xE3, 0x80, 0x80, 3)):
        at = np.flatnonzero(raw[:-1] == lead)
        at = at[(raw[at + 1] >= low) & (raw[at + 1] <= high)]
        inside[spread(at, np.full(len(at), size))] = False
    edge = np.zeros(len(inside), bool)
    edge[offsets] = True
    before = np.r_[False, inside[:-1]]
    starts = np.flatnonzero(inside & (~before | edge))
    stops = np.flatnonzero(before & (~inside | edge))
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def terms_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, term, count: each distinct term of each text, by text and term."""
    raw, offsets = flat_text(pc.utf8_lower(texts.cast(pa.large_string())))
    start, stop, text = word_spans(raw, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = Rolling(byte_values(raw))
    known, word = np.unique(hashes.of(start, stop), return_inverse=True)
    pairs, count = np.unique(text * len(known) + word, return_counts=True)
    return pairs // len(known), known[pairs % len(known)], count


def find(vocabulary: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Number of each term in the sorted vocabulary, -1 where it is not there."""
    if not len(vocabulary):
        return np.full(len(terms), -1)
    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    return np.where(vocabulary[at] == terms, at, -1)


def runs(sizes: np.ndarray) -> Iterator[tuple[slice, np.ndarray, slice]]:
    """Examples with `sizes` terms each in runs of about RUN terms: the examples, which of them holds each term, the terms."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + RUN, "right")))
        yield slice(at, stop), np.repeat(np.arange(stop - at), sizes[at:stop]), slice(base, int(ends[stop - 1]))
        at = stop


def held_in(term: np.ndarray, sizes: np.ndarray, size: int, who: np.ndarray | None = None) -> np.ndarray:
    """How many examples (of those marked in who) hold each of `size` terms."""
    held = np.zeros(size, np.int64)
    for some, own, run in runs(sizes):
        held += np.bincount(term[run] if who is None else term[run][who[some][own]], minlength=size)
    return held


@dataclass
class Index:
    """Unit vectors of the examples by term: row and weight in the two halves of posting[start[term] : start[term + 1]].

    Block b holds the rows b, b + blocks, b + 2 * blocks, ...; rows that fill up the last ones have doc -1 and no terms."""

    vocabulary: np.ndarray
    idf: np.ndarray
    doc: np.ndarray
    label: np.ndarray
    start: np.ndarray
    posting: np.ndarray

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts, dtype=float)) * self.idf[terms]  # counts of one byte have logarithms in half precision otherwise
        return w / np.sqrt((w**2).sum()) if len(w) else w

    @staticmethod
    def build(vocabulary: np.ndarray, idf: np.ndarray, doc: np.ndarray, label: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Index:
        """Examples with `sizes` terms each (one at least), whose numbers and counts follow each other in `term` and `tf`."""
        single = idf.astype(np.float32)
        head, length = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.float32)
        for some, own, run in runs(sizes):
            weight = Index._weights(single, term[run], tf[run])
            first = np.searchsorted(own, np.arange(some.stop - some.start))
            heads = np.flatnonzero(weight == np.maximum.reduceat(weight, first)[own])
            head[some] = term[run][heads[np.searchsorted(heads, first)]]
            length[some] = np.sqrt(np.bincount(own, weights=weight**2))
        # Examples with the same leading term share blocks, which keeps bounds tight.
        order = np.lexsort((doc, label, head))
        blocks = -(-len(doc) // BLOCK)
        place = np.arange(len(doc)) % BLOCK * blocks + np.arange(len(doc)) // BLOCK
        number = np.empty(len(doc), np.int32)
        number[order] = place
        names, kinds = np.full(blocks * BLOCK, -1, np.int64), np.zeros(blocks * BLOCK)
        names[place], kinds[place] = doc[order], label[order]
        start = np.r_[0, np.cumsum(held_in(term, sizes, len(idf)))].astype(np.int32)
        # Each run of examples is sorted by term and dealt to the places that are still free.
        posting, free = np.empty(len(term), np.int64), start[:-1].astype(np.int64)
        for some, own, run in runs(sizes):
            by = np.argsort(term[run], kind="stable")
            terms, first, held = np.unique(term[run][by], return_index=True, return_counts=True)
            weight = Index._weights(single, term[run], tf[run]) / length[some][own]
            made = number[some][own[by]].astype(np.int64) << 32
            made |= weight[by].view(np.uint32)
            posting[spread(free[terms], held)] = made
            free[terms] += held
        return Index(vocabulary, idf, names, kinds, start, posting)

    @staticmethod
    def _weights(idf: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        weight = np.log(tf.astype(np.float32))
        weight += 1
        weight *= idf[term]
        return weight

    @staticmethod
    def parts(posting: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return posting >> 32, posting.astype(np.uint32).view(np.float32)

    @cached_property
    def frequent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each term among the frequent ones (-1: none), weights of these by example, and their block maxima."""
        held = np.diff(self.start)
        often = np.sort(np.argsort(-held, kind="stable")[:OFTEN])
        place = np.full(len(held), -1, np.int16)
        place[often] = np.arange(len(often))
        rows = np.zeros((len(self.doc), len(often)), np.float32)
        for at, (first, size) in enumerate(zip(self.start[often].tolist(), held[often].tolist())):
            row, weight = self.parts(self.posting[first : first + size])
            rows[row, at] = weight
        give_back()
        return place, rows, rows.reshape(BLOCK, len(rows) // BLOCK, len(often)).max(axis=0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "frequent"}

    def _rare(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the postings of some terms add to the cosine of every example."""
        if not len(terms):
            return np.zeros(len(self.doc))
        first, last = self.start[terms], self.start[terms + 1]
        row, weight = self.parts(np.concatenate([self.posting[a:b] for a, b in zip(first.tolist(), last.tolist())]))
        return np.bincount(row, weights=np.repeat(weights.astype(np.float32), last - first) * weight, minlength=len(self.doc))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights) the example numbers and cosines of the k nearest that share a term (ties: lower number).

        Example but[i] is left out for query i."""
        n = len(self.doc)
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        place, rows, most = self.frequent
        often = np.zeros((len(queries), rows.shape[1]))
        rare = np.empty((len(queries), n))
        for i, (terms, weights) in enumerate(queries):
            mine = place[terms] >= 0
            often[i, place[terms[mine]]] = weights[mine]
            rare[i] = self._rare(terms[~mine], weights[~mine])
            if but is not None:
                rare[i, self.doc == but[i]] = -np.inf
        single = often.astype(np.float32)
        upper = single @ most.T
        blocks = len(most)
        inside = np.arange(BLOCK)[:, None] * blocks
        complete = lambda i, some: rare[i, some] + rows[some].astype(float) @ often[i]
        kth = lambda x: max(0.0, np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else 0.0
        left, least = {}, {}
        for i in range(len(queries)):
            bound = rare[i].reshape(BLOCK, blocks).max(axis=0) + upper[i]
            some = np.argpartition(-bound, FIRST)[:FIRST] if blocks > FIRST else np.arange(blocks)
            least[i] = kth(complete(i, (inside + some).ravel())) - ROUNDING
            left[i] = np.flatnonzero(bound >= least[i])
        many = [i for i in left if len(left[i]) > MANY]
        left = {i: np.sort((inside + x).ravel()) for i, x in left.items() if len(x) <= MANY}
        if many:
            for i, cosine in zip(many, single[many] @ rows.T):
                cosine = rare[i] + cosine
                found = np.flatnonzero(cosine >= least[i])
                left[i] = found[cosine[found] >= kth(cosine[found]) - ROUNDING]
        out = []
        for i in range(len(queries)):
            found = left[i]
            cosine = complete(i, found)
            found, cosine = found[cosine > 0], cosine[cosine > 0]
            top = np.lexsort((found, -cosine))[:k]
            out.append((found[top], cosine[top]))
        return out

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]], prior: float, but: list[int] | None = None) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Share of toxic votes, neighbours and cosines of texts given by their terms and counts."""
        for at in range(0, len(texts), BATCH):
            queries = [(t, self.vector(t, c)) for t, c in texts[at : at + BATCH]]
            for near, cosine in self.nearest(queries, NEIGHBOURS, but and but[at : at + BATCH]):
                weight = cosine**2
                yield float((weight @ self.label[near] + PRIOR_VOTES * prior) / (weight.sum() + PRIOR_VOTES)), near, cosine


def examples_of(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """doc_id, y, text of the bounded sample of labelled documents."""
    known = labels.filter(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
    order = (F.xxhash64("doc_id"), "doc_id")
    some = known.filter("y = 1").orderBy(*order).limit(MOST_TOXIC).unionByName(known.filter("y = 0").orderBy(*order).limit(MOST_CLEAN))
    # At most MOST_TOXIC + MOST_CLEAN rows of two numbers.
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")
    # Copies of one text would make all of its words look telling.
    one = found.groupBy(F.xxhash64("text").alias("same"), "y").agg(F.min(F.struct("doc_id", "text")).alias("d"))
    return one.select("d.doc_id", "y", "d.text")


def coded(examples: DataFrame) -> DataFrame:
    """doc_id, y, terms, counts: the terms of every example as blobs (stored)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                text, term, count = terms_in(part.column("text"))
                cut = np.searchsorted(text, np.arange(1, part.num_rows))
                blobs = [pa.array([x.tobytes() for x in np.split(term, cut)], pa.binary()), pa.array([narrow(x) for x in np.split(count, cut)], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), *blobs], ["doc_id", "y", "terms", "counts"])

    return settle(examples.mapInArrow(run, "doc_id bigint, y int, terms binary, counts binary"), "coded", TERMS)


def narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(counts.max(initial=0))).tobytes()


def wide(blob: bytes, size: int) -> np.ndarray:
    """The `size` counts of a blob."""
    return np.frombuffer(blob, f"u{len(blob) // size}") if size else np.zeros(0, np.uint8)


def vocabulary_of(rows: DataFrame) -> np.ndarray:
    """All terms of the coded examples, ordered."""
    parts = shuffle_partitions(rows)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "terms", TERMS):
                terms = np.unique(_values(some.column("terms"), np.uint64))
                to = (terms % np.uint64(parts)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(parts + 1))
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([terms[order[cut[p] : cut[p + 1]]].tobytes() for p in full], pa.binary())], ["part", "terms"])

    def once(table: pa.Table) -> pa.Table:
        return pa.table({"terms": pa.array([np.unique(_values(table.column("terms"), np.uint64)).tobytes()], pa.binary())})

    found = rows.select("terms").mapInArrow(emit, "part int, terms binary").groupBy("part").applyInArrow(once, "terms binary")
    return np.sort(_values(_collected(found).column("terms"), np.uint64))  # eight bytes for each term of the bounded sample


def numbered(rows: DataFrame, vocabulary: Broadcast[np.ndarray]) -> DataFrame:
    """doc_id, y, terms, counts of the coded examples, with the numbers of the terms (four bytes) for their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "terms", TERMS):
                terms = [find(vocabulary.value, np.frombuffer(b, np.uint64)).astype(np.int32).tobytes() for b in part.column("terms").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(terms, pa.binary()), part.column("counts")], ["doc_id", "y", "terms", "counts"])

    return rows.select("doc_id", "y", "terms", "counts").mapInArrow(run, "doc_id bigint, y int, terms binary, counts binary")


def frequencies(docs: DataFrame, vocabulary: Broadcast[np.ndarray], size: int) -> tuple[np.ndarray, int]:
    """In how many documents each term stands, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                rows += part.num_rows
                at = find(vocabulary.value, terms_in(part.column("text"))[1])
                held += np.bincount(at[at >= 0], minlength=size + 1)
        held[size] = rows
        chunks = range(0, size + 1, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK for c in chunks], pa.int32()), pa.array([held[c : c + CHUNK].tobytes() for c in chunks], pa.binary())], ["chunk", "held"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), np.int64) for b in table.column("held"))
        return pa.table({"chunk": table.column("chunk")[:1], "held": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(run, "chunk int, held binary").groupBy("chunk").applyInArrow(add, "chunk int, held binary")
    rows = _collected(parts).sort_by("chunk").column("held").to_pylist()  # one number for each term
    out = np.concatenate([np.frombuffer(b, np.int64) for b in rows]) if rows else np.zeros(size + 1, np.int64)
    return out[:size], int(out[size])


def telling(a: np.ndarray, b: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
    """One plus the root of each term's chi-square with the label, from how many toxic and clean examples of these numbers hold it."""
    pos, neg = (float(s) for s in sizes)
    n = pos + neg
    spare = n - a - b
    return 1 + np.sqrt(np.where((spare > 0) & (a + b > 0), n * (a * neg - b * pos) ** 2 / max(pos * neg, 1) / (np.maximum(a + b, 1) * np.maximum(spare, 1)), 0.0))


@dataclass
class Judge:
    index: Broadcast[Index]
    prior: float
    alone: float
    edges: np.ndarray
    levels: np.ndarray

    def judged(self, texts: pa.Array) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Score, neighbours and cosines of each text."""
        index = self.index.value
        text, term, count = terms_in(texts)
        at = find(index.vocabulary, term)
        text, at, count = text[at >= 0], at[at >= 0], count[at >= 0]
        cut = np.searchsorted(text, np.arange(len(texts) + 1))
        found = index.votes([(at[a:b], count[a:b]) for a, b in zip(cut[:-1], cut[1:])], self.prior)
        return [(float(np.interp(vote, self.edges, self.levels)) if len(near) else self.alone, near, cosine) for vote, near, cosine in found]


def _collected(df: DataFrame) -> pa.Table:
    """All rows of df; on the way its texts and terms reach Python in small batches."""
    with small_batches(df.sparkSession, TERMS):
        return df.toArrow()


def _values(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """The blobs of a column, one after another."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(flat_blob(c), kind) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]))])


def flat_blob(chunk: pa.BinaryArray) -> pa.Buffer | bytes:
    _, offsets, data = chunk.buffers()
    at = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
    return data[int(at[0]) : int(at[-1])] if data is not None else b""


def learn_judge(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> Judge:
    context = docs.sparkSession.sparkContext
    rows = coded(examples_of(docs, labels, label, learn))
    vocabulary = vocabulary_of(rows)
    shared = context.broadcast(vocabulary)  # bounded by the sample
    sample = _collected(numbered(rows, shared))  # the terms of the bounded sample, five bytes each
    doc, y = sample.column("doc_id").to_numpy(), sample.column("y").to_numpy().astype(float)
    sizes = pc.binary_length(sample.column("terms")).to_numpy().astype(np.int64) // 4
    counts = np.concatenate([np.zeros(0, np.uint8), *(wide(b.as_py(), n) for b, n in zip(sample.column("counts"), sizes.tolist()))])
    sample = sample.select(["terms"])
    term = _values(sample.column("terms"), np.int32)
    del sample
    prior = ((y == 1).sum() + 0.5) / (len(y) + 1)
    if not ((y == 1).any() and (y == 0).any()):
        vocabulary, doc, y, sizes, term, counts = vocabulary[:0], doc[:0], y[:0], sizes[:0], term[:0], counts[:0]
    give_back()
    frequency, total = frequencies(docs, shared, len(vocabulary)) if len(vocabulary) else (np.zeros(0), 0)
    shared.unpersist()
    held = sizes > 0

    def index_by(teachers: np.ndarray) -> Broadcast[Index]:
        a, b = (held_in(term, sizes, len(vocabulary), teachers & (y == kind)) for kind in (1, 0))
        told = telling(a, b, ((y[teachers] == 1).sum(), (y[teachers] == 0).sum()))
        index = Index.build(vocabulary, told * (np.log((1 + total) / (1 + frequency)) + 1), doc[held], y[held], sizes[held], term, counts)
        shared = context.broadcast(index)  # bounded by the sample
        del index
        give_back()
        return shared

    # Votes are calibrated on examples whose labels weigh no term; documents are judged with weights of all examples.
    index = index_by(half_of(doc))

    def without_itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for b in batches:
            b = b.filter(pa.array(~half_of(b.column("doc_id").to_numpy()) & (pc.binary_length(b.column("terms")).to_numpy() > 0)))
            texts = [(find(own.vocabulary, np.frombuffer(t, np.uint64)), wide(c, len(t) // 8)) for t, c in zip(b.column("terms").to_pylist(), b.column("counts").to_pylist())]
            votes = [v[0] for v in own.votes(texts, prior, b.column("doc_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), b.column("y").cast(pa.float64())], ["vote", "y"])

    own = _collected(rows.repartition(shuffle_partitions(docs)).mapInArrow(without_itself, "vote double, y double")) if len(vocabulary) else pa.table({"vote": pa.array([], pa.float64()), "y": pa.array([], pa.float64())})
    votes, truth = own.column("vote").to_numpy(), own.column("y").to_numpy()
    order = np.argsort(votes, kind="stable")
    votes, truth = votes[order], truth[order]
    if len(votes):
        values, start = np.unique(votes, return_index=True)
        edges, levels = isotonic(values, np.diff(np.r_[start, len(votes)]), np.add.reduceat(truth, start))
    else:
        edges, levels = np.array([prior]), np.array([prior])
    quiet = truth[votes <= prior]
    index.destroy()
    return Judge(index_by(np.ones(len(doc), bool)), float(prior), float((quiet.sum() + prior) / (len(quiet) + 1)), edges, levels)


def half_of(doc: np.ndarray) -> np.ndarray:
    """Which examples teach the weights of terms; the others calibrate."""
    x = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(63)).astype(bool)


def score_documents(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """doc_id, score, and as evidence the nearest examples with their cosines, of every document."""
    judge = learn_judge(docs, labels, label, learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                made = judge.judged(part.column("text"))
                doc = judge.index.value.doc
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([m[0] for m in made], pa.float64()), pa.array([doc[m[1]].tolist() for m in made], pa.list_(pa.int64())), pa.array([m[2].tolist() for m in made], pa.list_(pa.float64()))],
                    ["doc_id", "score", "near_ids", "near_cosines"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, near_ids array<bigint>, near_cosines array<double>")


def without_toxic(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: float = 0.5) -> DataFrame:
    """The rows of docs that score below `limit`, unchanged.

    Stored once, so that texts reach Python in small batches whoever reads the rows."""
    judge = learn_judge(docs, labels, label, learn)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE):
                yield part.filter(pa.array([m[0] < limit for m in judge.judged(part.column(text))], pa.bool_()))

    renamed = docs.toDF(*names)
    kept = renamed.mapInArrow(run, ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema)))
    return settle(kept, "clean", TERMS).toDF(*docs.columns)
