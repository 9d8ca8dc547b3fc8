"""SentencePiece encoding and decoding over a table of distinct marked words.

No piece of the vocabulary continues past a whitespace mark, so a text is segmented mark by mark: a chunk is a run of
marks with the word behind it. Every task keeps a table of the chunks it has met; the library segments each distinct
chunk once, and the ids of a text are the table's entries joined in order of position. The table is emptied at
``MAX_CHUNKS`` entries, so memory stays bounded whatever the vocabulary of the data. No shuffle is needed.

Defined results: a null text is an empty one, an empty text has no ids and decodes to the empty string; rows are
independent, so repeated rows, null ids and ties need no rule; an empty table gives an empty table. Ids outside the
vocabulary decode to null.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import slices, whole

MARK = "▁"
MAX_CHUNKS = 400_000
_CHUNK = re.compile(" *[^ ]+| +$")


@functools.lru_cache(maxsize=2)
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    """The library's model, after a check that chunks are independent: identity rule, dummy prefix, no crossing piece."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = next((p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if not re.fullmatch(f"{MARK}*[^{MARK}]*", p)), None)
    probe = "  Ａﬁ x"  # spaces kept, no compatibility folding, one mark put before the text
    if crossing or sp.decode(sp.encode(probe)) != probe or sp.encode(probe, out_type=str)[0][:1] != MARK:
        raise ValueError("this model merges across whitespace marks or rewrites texts; chunks would not be independent")
    return sp


class ChunkTable:
    """Distinct chunks, without their first mark, and their ids as little-endian 32-bit integers."""

    def __init__(self, path: str) -> None:
        self.sp = processor(path)
        self.ids: dict[str, bytes] = {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        words = text.split(" ")
        if "" not in words:
            return words
        return [c[1:] for c in _CHUNK.findall(" " + text)] if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.chunks(t.replace(MARK, " ")) for t in texts]
        if len(self.ids) > MAX_CHUNKS:
            self.ids = {}
        known = self.ids
        new = list({w for words in split for w in words if w not in known})
        for w, ids in zip(new, self.sp.encode(new, num_threads=1)):
            known[w] = np.array(ids, "<i4").tobytes()
        known[""] = np.array([self.sp.piece_to_id(MARK)], "<i4").tobytes()  # a text's last, lone mark
        return [b"".join([known[w] for w in words]) for words in split]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the text (null: empty), and the ids of the whole text as the library gives them."""
    src = docs.select(*keep, whole(text).alias(text))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(model)
        for batch in slices(batches, text, 2 << 20):
            parts = chunks.encode(batch.column(text).to_pylist())
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int64).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), flat)], names=[*batch.schema.names, ids])

    kinds = ", ".join(f"`{n}` {k}" for n, k in src.dtypes)
    return src.mapInArrow(run, f"{kinds}, `{ids}` array<int>")


class Decoder:
    """Bytes of every id; texts with control, unknown or malformed ids go to the library."""

    def __init__(self, path: str) -> None:
        self.sp = processor(path)
        size = self.sp.get_piece_size()
        self.plain = [not (self.sp.is_control(i) or self.sp.is_unknown(i)) for i in range(size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in ((i, self.sp.id_to_piece(i)) for i in range(size))]
        self.odd = np.array([not x for x in self.plain])

    def decode(self, ids: np.ndarray) -> str | None:
        if not len(ids):
            return ""
        if ids.min() < 0 or ids.max() >= len(self.bytes):
            return None
        listed = ids.tolist()
        if not self.odd[ids].any():
            raw = b"".join(map(self.bytes.__getitem__, listed))
            if raw[:1] == b" " and not self.sp.is_byte(listed[0]):
                raw = raw[1:]
            try:
                return raw.decode()
            except UnicodeDecodeError:
                pass
        return self.sp.decode(listed)


def decode(df: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text that the ids stand for. A null list or a null id gives null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(model)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(ids)
            flat, ends = lists.values, lists.offsets.to_numpy()
            values = flat.fill_null(-1).to_numpy(zero_copy_only=False)
            valid = lists.is_valid().to_pylist()
            out = [dec.decode(values[a:b]) if ok else None for a, b, ok in zip(ends[:-1], ends[1:], valid)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, decoded])

    kinds = ", ".join(f"`{n}` {k}" for n, k in df.dtypes)
    return df.mapInArrow(run, f"{kinds}, `{decoded}` string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document: number of ids, digest of the ids and digest of the text decoded from them."""
    ids = encode(docs.select("doc_id", "text"), model).drop("text")
    return decode(ids, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
