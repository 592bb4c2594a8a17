"""Number of unigram tokens of each text, without building the tokens.

An Aho-Corasick automaton reports every vocabulary entry that ends at each
letter of a word; a dynamic programme carries only the best score and the number
of pieces on that path.  Ties go as in the library: of equal scores the longest
last piece wins, and an unknown letter (scored below everything) only where no
one-letter entry exists and nothing else is better.  Unknown letters count one
token a byte.  Words are cut before each space mark, so a path never spans two.

A null or empty text has 0 tokens.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.textkit import slices

MARK = "▁"
#: Fixed: an unknown letter scores this much less than the lowest entry.
UNKNOWN_BELOW = 10.0
CACHE_WORDS = 1_000_000
UNREACHED = float("-inf")


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Unigram:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(pieces).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.letters = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_BELOW
        self.seen: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces on the best path of one word."""
        n = len(word)
        score, pieces = [0.0] + [UNREACHED] * n, [0] * (n + 1)
        if self.letters.issuperset(word):
            for end, (length, value) in self.automaton.iter(word):
                total = score[end + 1 - length] + value
                if total > score[end + 1]:
                    score[end + 1] = total
                    pieces[end + 1] = pieces[end + 1 - length] + 1
            return pieces[n]
        done = 0  # letters that have their best path
        for end, (length, value) in self.automaton.iter(word):
            while done < end:
                done += 1
                self._unknown(word, done, score, pieces)
            total = score[end + 1 - length] + value
            if total > score[end + 1]:
                score[end + 1] = total
                pieces[end + 1] = pieces[end + 1 - length] + 1
        while done < n:
            done += 1
            self._unknown(word, done, score, pieces)
        return pieces[n]

    def _unknown(self, word: str, end: int, score: list, pieces: list) -> None:
        letter = word[end - 1]
        if letter not in self.letters and score[end - 1] + self.unknown > score[end]:
            score[end] = score[end - 1] + self.unknown
            pieces[end] = pieces[end - 1] + len(letter.encode())

    def count_text(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        words = (text if text[0] == MARK else MARK + text).split(MARK)[1:]
        seen, total = self.seen, 0
        for w in words:
            n = seen.get(w)
            if n is None:
                if len(seen) > CACHE_WORDS:
                    seen.clear()
                n = self.count(MARK + w)
                if len(w) < 64:
                    seen[w] = n
            total += n
        return total


_LOADED: dict[str, Unigram] = {}


def load(path: str) -> Unigram:
    if path not in _LOADED:
        _LOADED[path] = Unigram(read_pieces(path))
    return _LOADED[path]


def count_tokens(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens for every row of df(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for part in slices(batch):
                counts = np.array([model.count_text(t or "") for t in part.column("text").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts)], ["doc_id", "n_tokens"])

    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")
