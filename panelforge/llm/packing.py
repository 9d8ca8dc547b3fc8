"""Packing of token sequences into windows by the sum-of-squares rule.

A document is cut into full windows and a rest. Rests are placed online: among the fill levels that have a partly
filled window with room, and a new window, the one is taken that makes the sum of squared counts of partly filled windows
smallest (ties: the fuller level). Counts per level stand in an array, so a placement is one vector operation. What
is still open at the end of a task is laid end to end and cut into full windows; the last tokens are cut into
powers of two, which need no padding.

Each task packs the rows it reads; nothing is shuffled and open windows are bounded by the level counts. Window
numbers hold the task's number in their high bits, so they are unique and repeat when a task is run again.

Defined results: a null text is empty and gives the end token alone; null ids and repeated rows are packed like any
others; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from panelforge.llm.common import slices, whole

END = 0
MAX_SEGMENTS = 400_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_BLANKS = re.compile(r"\s\s")


@functools.lru_cache(maxsize=2)
def _byte_bpe(vocabulary: str, ranks: str, pattern: str):
    with open(ranks, "rb") as f:
        merges = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    exact = tokenizers.Tokenizer.from_file(vocabulary)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={}), exact, [t.content for t in exact.get_added_tokens_decoder().values()]


class ByteBpe:
    """Ids of a byte-level BPE as little-endian 32-bit integers.

    A segment is a whitespace character with the word behind it; where no two whitespace characters are adjacent, the pre-tokenizer
    never joins segments, so each distinct segment is encoded once and kept.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str) -> None:
        self.fast, self.exact, self.special = _byte_bpe(vocabulary, ranks, pattern)
        self.spaced: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def _new(self, word: str) -> bytes:
        """A segment of a space and ``word``; a stop or comma behind a letter is a token of its own."""
        ids = None
        if word[-1:] in (",", ".") and word[-2:-1].isalpha() and (stem := self.spaced.get(word[:-1])) is not None:
            ids = stem + self._ids(word[-1])
        self.spaced[word] = ids = self._ids(" " + word) if ids is None else ids
        return ids

    def encode(self, text: str) -> bytes:
        if _BLANKS.search(text):
            return self._ids(text)
        if len(self.spaced) > MAX_SEGMENTS:
            self.spaced = {}
        known, out = self.spaced, []
        for i, line in enumerate(text.split("\n")):
            first, *words = line.split(" ")
            out.append(self._ids("\n" + first if i else first))
            out += [known.get(w) or self._new(w) for w in words]
        return b"".join(out)


class SumOfSquares:
    """Online placement of pieces shorter than a window; pieces are (document, start, ids)."""

    def __init__(self, window: int, first: int) -> None:
        self.window, self.next = window, first
        self.count = np.zeros(window + 1, np.int64)  # the last level, full, is not counted
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(window)]

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, piece: tuple, size: int) -> tuple[int, list] | None:
        """Put a piece into a window; the window if that fills it."""
        n, w = self.count, self.window
        before, after = n[: w - size + 1], n[size:]
        change = 2 * (after - before) + 2
        change[-1] -= 1 + 2 * after[-1]
        change[before == 0] = np.iinfo(np.int64).max
        change[0] = 2 * n[size] + 1
        level = w - size - int(np.argmin(change[::-1]))
        seq, pieces = self.open[level].pop() if level else (self.fresh(), [])
        n[level] -= level > 0
        pieces.append((level, piece))
        if level + size == w:
            return seq, pieces
        n[level + size] += 1
        self.open[level + size].append((seq, pieces))
        return None

    def rest(self) -> Iterator[tuple[int, list]]:
        """Windows cut from what is open, level by level; the last ones hold powers of two."""
        pieces = [p for level in self.open for _, held in level for _, p in held]
        left = sum(len(p[2]) for p in pieces) // 4
        room, at, held, seq = 0, 0, [], -1
        for doc, start, ids in pieces:
            done = 0
            while done < len(ids) // 4:
                if not room:
                    if held:
                        yield seq, held
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                    at, held, seq = 0, [], self.fresh()
                take = min(room, len(ids) // 4 - done)
                held.append((at, (doc, start + done, ids[4 * done : 4 * (done + take)])))
                done, at, room, left = done + take, at + take, room - take, left - take
        if held:
            yield seq, held


def pack(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, window: int = 1024, text: str = "text") -> DataFrame:
    """One row per piece: document, start and length in its ids, their CRC, the document's tokens, window and offset there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, bins = ByteBpe(vocabulary, ranks, pattern), SumOfSquares(window, TaskContext.get().partitionId() << 40)
        end = np.array([END], "<u4").tobytes()
        rows: list[tuple] = []

        def put(filled) -> None:
            seq, pieces = filled
            rows.extend((doc, start, len(ids) // 4, zlib.crc32(ids), total, seq, at) for at, ((doc, total), start, ids) in pieces)

        for batch in slices(batches, text):
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = bpe.encode(body) + end
                doc = (doc_id, total := len(ids) // 4)
                whole_windows = total - total % window
                for start in range(0, whole_windows, window):
                    put((bins.fresh(), [(0, (doc, start, ids[4 * start : 4 * (start + window)]))]))
                if total > whole_windows and (full := bins.place((doc, whole_windows, ids[4 * whole_windows :]), total - whole_windows)):
                    put(full)
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows.clear()
        for filled in bins.rest():
            put(filled)
        if rows:
            yield _batch(rows)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole(text).alias(text)).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
