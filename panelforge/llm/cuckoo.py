"""Exact deduplication through cuckoo-filter indexes over the digests of whole texts.

Each task holds one index of the digests it is responsible for. A digest is looked up by a 16-bit tag in two buckets
of four slots; a tag that matches is a hit only if the full digest kept in the same slot agrees. A new digest is
inserted, moving others to their second bucket; when the moves exceed their limit the index doubles and is refilled from the kept
digests. Digests can be deleted while live.

Distribution: every input task first folds its own rows (one row per digest leaves it), so a text held by a third
of all rows costs one row per task; the folded rows are dealt out by digest and folded again. An index in an input
task is flushed at ``FLUSH`` digests; partial results may be flushed at any time, so memory is bounded there. After the
exchange a task holds its share of the distinct digests.

Defined results: null text is empty text; of equal texts the row with the largest doc_id stays (null doc_id is
smallest, and of rows equal in both the later stored one stays); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.staging import releasing, staged
from panelforge.llm.common import ROW, hash_parts, row_apart, whole, with_row

SLOTS = 4
MAX_MOVES = 200
FLUSH = 200_000
PER_TASK = 200_000


class Entry:
    __slots__ = ("digest", "keep_id", "keep_row", "size", "gone")

    def __init__(self, digest: bytes) -> None:
        self.digest, self.keep_id, self.keep_row, self.size, self.gone = digest, None, -1, 0, False

    def add(self, doc_id: int | None, row: int, size: int) -> None:
        self.size += size
        if size and (self.keep_row < 0 or _order(doc_id, row) > _order(self.keep_id, self.keep_row)):
            self.keep_id, self.keep_row = doc_id, row


def _order(doc_id: int | None, row: int) -> tuple:
    return (doc_id is not None, doc_id or 0, row)


class CuckooIndex:
    """Cuckoo filter with the live entries kept slot by slot."""

    def __init__(self, buckets: int = 1 << 10) -> None:
        self._clear(buckets)
        self.live = 0

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags = [0] * (buckets * SLOTS)
        self.kept: list[Entry | None] = [None] * (buckets * SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[:2], "little") % 65535 + 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ (tag * 0x9E3779B1 >> 7 & self.mask)

    def _find(self, digest: bytes) -> int:
        tag, *buckets = self._places(digest)
        for b in buckets:
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.tags[s] == tag and self.kept[s].digest == digest:
                    return s
        return -1

    def get(self, digest: bytes) -> Entry | None:
        s = self._find(digest)
        return None if s < 0 else self.kept[s]

    def insert(self, entry: Entry) -> None:
        """Insert a digest that is not live."""
        self.live += 1
        while (entry := self._place(entry)) is not None:
            self._grow()

    def _place(self, entry: Entry) -> Entry | None:
        """Place an entry, moving others; the one left over if the moves reach their limit."""
        tag, first, second = self._places(entry.digest)
        for b in (first, second):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.tags[s]:
                    self.tags[s], self.kept[s] = tag, entry
                    return None
        bucket = first
        for move in range(MAX_MOVES):
            s = bucket * SLOTS + move % SLOTS
            self.tags[s], tag = tag, self.tags[s]
            self.kept[s], entry = entry, self.kept[s]
            bucket = self._other(bucket, tag)
            for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.tags[s]:
                    self.tags[s], self.kept[s] = tag, entry
                    return None
        return entry

    def _grow(self) -> None:
        """Twice the buckets or more, refilled from the kept digests."""
        entries, buckets = list(self.entries()), (self.mask + 1) * 2
        while True:
            self._clear(buckets)
            if all(self._place(e) is None for e in entries):
                return
            buckets *= 2

    def delete(self, digest: bytes) -> Entry | None:
        """Take a live digest off the index."""
        s = self._find(digest)
        if s < 0:
            return None
        entry, self.kept[s], self.tags[s] = self.kept[s], None, 0
        self.live -= 1
        return entry

    def entries(self) -> Iterator[Entry]:
        return (e for e in self.kept if e is not None)


SCHEMA = f"digest binary, doc_id long, `{ROW}` long, size long, gone boolean"


def _fold(flush: int | None, final: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, doc_id, row, size, gone in zip(*(c.to_pylist() for c in batch.columns)):
                entry = index.get(digest)
                if entry is None:
                    index.insert(entry := Entry(digest))
                entry.add(doc_id, row, size)
                entry.gone |= gone
            if flush and index.live > flush:
                yield from _out(index)
                index = CuckooIndex()
        if final:
            for digest in [e.digest for e in index.entries() if e.gone]:
                index.delete(digest)
        yield from _out(index)

    return run


def _out(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = list(index.entries())
    for i in range(0, len(rows), 50_000):
        part = rows[i : i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([e.digest for e in part], pa.binary()), pa.array([e.keep_id for e in part], pa.int64()), pa.array([e.keep_row for e in part], pa.int64()), pa.array([e.size for e in part], pa.int64()), pa.array([e.gone for e in part], pa.bool_())],
            names=["digest", "doc_id", ROW, "size", "gone"],
        )


def index_of(rows: DataFrame) -> DataFrame:
    """One row per live digest of ``rows`` (digest, doc_id, row, size, gone): the row that stays and the group's size."""
    local = rows.select("digest", F.col("doc_id").cast("long"), ROW, "size", "gone").mapInArrow(_fold(FLUSH, False), SCHEMA)
    return local.repartition(hash_parts(rows, rows.count(), PER_TASK), "digest").mapInArrow(_fold(None, True), SCHEMA)


def duplicates(docs: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, its row mark, keep_id, group_size, kept and the text's digest.

    ``withdrawn`` (column text) lists texts to take off the index again: their rows are not kept and have no keep_id.
    """
    return _duplicates(with_row(docs.select("doc_id", "text")), withdrawn)


def _duplicates(docs: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    marked = docs.select("doc_id", ROW, F.unhex(F.sha2(whole().cast("binary"), 256)).alias("digest"))
    rows = staged(marked, "digests")
    live = rows.select("*", F.lit(1).cast("long").alias("size"), F.lit(False).alias("gone"))
    if withdrawn is not None:
        off = withdrawn.select(F.lit(None).cast("long").alias("doc_id"), F.lit(-1).cast("long").alias(ROW), F.unhex(F.sha2(whole().cast("binary"), 256)).alias("digest"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("gone"))
        live = live.unionByName(off)
    best = index_of(live).select("digest", F.col("doc_id").alias("keep_id"), F.col(ROW).alias("keep_row"), F.col("size").alias("group_size"))
    return rows.join(best, "digest", "left").select(
        "doc_id", ROW, "keep_id", F.coalesce("group_size", F.lit(0)).cast("long").alias("group_size"),
        F.coalesce(F.col(ROW) == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


@row_apart
def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    marked = with_row(docs)
    with releasing(docs.sparkSession):
        gone = staged(_duplicates(marked).where("NOT kept").select(ROW), "gone", keep=True)
    return marked.join(gone, ROW, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
