"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton over the vocabulary gives all pieces that end at a position; dynamic programming carries the best score
and the number of pieces of that path, nothing else. Tie rules are those of the ``tokenizers`` unigram model: sources are relaxed from left
to right and replaced only by a better score, so of equal paths the one whose last piece starts first stays; a
character that is no piece of its own costs ten less than the smallest score and counts one piece per UTF-8 byte.

No piece continues past a whitespace mark, so paths of chunks (marks and the word behind them) are independent;
each task keeps count and score of the distinct chunks it has met, up to ``MAX_CHUNKS``. Scores are summed in 64 bits.

Defined results: null text is empty; an empty text has no tokens and score zero; repeated rows are counted alike; an
empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import slices, whole
from panelforge.llm.pieces import MARK, MAX_CHUNKS, ChunkTable, processor

PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    pieces: dict[str, float]
    byte_fallback: bool
    unknown: float


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a model file."""
    sp = processor(path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = {sp.id_to_piece(i): float(sp.get_score(i)) for i in ids}
    return Vocabulary(pieces, any(sp.is_byte(i) for i in range(sp.get_piece_size())), min(pieces.values()) - PENALTY)


class Counter:
    """Best score and number of pieces of marked text."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.automaton = ahocorasick.Automaton()
        for piece, score in v.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.kept: dict[str, tuple[int, float]] = {}

    def best(self, marked: str) -> tuple[int, float]:
        n = len(marked)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(marked):
            ends[end].append(match)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for i, matches in enumerate(ends):
            matches.sort(reverse=True)
            if not matches or matches[-1][0] > 1:
                matches.append((1, self.v.unknown))
                size = len(marked[i].encode()) if self.v.byte_fallback else 1
            else:
                size = 1
            top, pieces = None, 0
            for length, s in matches:
                path = score[i + 1 - length] + s
                if top is None or path > top:
                    top, pieces = path, count[i + 1 - length] + (size if length == 1 else 1)
            score[i + 1], count[i + 1] = top, pieces
        return count[n], score[n]

    def text(self, text: str) -> tuple[int, float]:
        if len(self.kept) > MAX_CHUNKS:
            self.kept = {}
        kept, n, total = self.kept, 0, 0.0
        for chunk in ChunkTable.chunks(text.replace(MARK, " ")) if text else ():
            found = kept.get(chunk)
            if found is None:
                found = kept[chunk] = self.best(MARK + chunk.replace(" ", MARK))
            n += found[0]
            total += found[1]
        return n, total


def counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and score of the best path of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(model))
        for batch in slices(batches, "text"):
            found = [counter.text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long"), whole().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, score double")
