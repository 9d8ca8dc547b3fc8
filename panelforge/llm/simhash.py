"""SimHash near-duplicates through covering locality-sensitive hashing.

For radius r every bit position gets a non-zero vector of r + 1 bits; the mask of table v (all non-zero v) keeps the positions
whose vector has an odd product with v. Any r positions span less than the whole space, so some v is orthogonal to
all of them: two fingerprints that differ in at most r positions agree under that mask. So every pair within
the radius meets in some table, whatever the data.

Distinct fingerprints only are dealt to the tables (equal texts and equal fingerprints cost one row). In a bucket a search
tree links each fingerprint to one it was reached from; pairs are neither enumerated nor emitted. A bucket of more
than ``SPLIT`` fingerprints is dealt again: its free positions fall into r + 1 parts and two fingerprints within the radius agree
on one part at least, so parts are the keys of smaller buckets and no link is lost.

Defined results: null text is empty; a document without words has fingerprint zero and is linked like any
other; null ids are allowed (component_id is the smallest non-null doc_id); repeated rows are documents of their own;
an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.staging import staged
from panelforge.llm.common import ROW, hash_parts, slices, whole, with_row
from panelforge.llm.components import components

SEED = 42
SPLIT = 4096
PER_TASK = 1_500_000
BLOCK = 1 << 16


def fingerprint(text: bytes, words: int, distinct: bool = False) -> int:
    """64 bits as a signed integer; a bit is set if more than half of the shingle hashes have it (``distinct``: each shingle once)."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in (set(shingles) if distinct else shingles)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row mark and fingerprint of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = [fingerprint(t.encode(), words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(ROW), pa.array(fps, pa.int64())], names=["doc_id", ROW, "fp"])

    rows = (docs if ROW in docs.columns else with_row(docs.select("doc_id", "text"))).select(F.col("doc_id").cast("long"), ROW, whole().alias("text"))
    return rows.mapInArrow(run, f"doc_id long, `{ROW}` long, fp long")


@functools.lru_cache(maxsize=8)
def covering_masks(radius: int, draws: int = 50) -> list[int]:
    """2^(radius+1) - 1 masks over 64 positions; of some seeded draws of vectors, the one whose smallest mask is largest."""
    top = (1 << radius + 1) - 1
    best: list[int] = [0]
    for seed in range(draws):
        vectors = [1 + i % top for i in range(max(64, top))]
        random.Random(seed).shuffle(vectors)
        masks = [sum((bin(vectors[i] & v).count("1") & 1) << i for i in range(64)) for v in range(1, top + 1)]
        best = max(best, masks, key=lambda m: min(x.bit_count() for x in m))
    return best


def _parts(mask: int, n: int) -> list[int]:
    """The positions outside a mask, dealt to n parts."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [sum(1 << i for i in free[p::n]) for p in range(n)]


def tree(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as indices) of a search forest over distinct fingerprints: each is compared with those not reached yet."""
    a, b, left, todo, x = [], [], np.arange(len(fps)), [], fps  # x: of those left
    while len(left):
        if not todo:
            todo, left, x = [left[0]], left[1:], x[1:]
        source = todo.pop()
        near = np.bitwise_count(x ^ fps[source]) <= radius
        if near.any():
            new = left[near]
            left, x = left[~near], x[~near]
            todo.extend(new)
            a.append(np.full(len(new), source))
            b.append(new)
    return (np.concatenate(a), np.concatenate(b)) if a else (left, left)


CELLS = "tab int, key long, fp long, fp_b long"


def _cells(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in CELLS.split(", ")])


def _bucket_links(radius: int, split: int | None):
    """Rows (table, key, fp), each bucket whole in one task -> links (table -1, two nodes), and rows of large buckets unchanged."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        tab, key, fp = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        del held
        order = np.lexsort((key, tab))
        tab, key, fp = tab[order], key[order], fp[order]
        starts = np.flatnonzero(np.r_[True, (tab[1:] != tab[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[starts, len(fp)])
        two = starts[sizes == 2]
        near = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius
        a, b = [two[near]], [two[near] + 1]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            if split and n > split:
                part = slice(s, s + n)
                yield _cells(tab[part], key[part], fp[part], fp[part])
                continue
            x, y = tree(fp[s : s + n].view(np.uint64), radius)
            a.append(x + s)
            b.append(y + s)
        a, b = np.concatenate(a), np.concatenate(b)
        yield _cells(np.full(len(a), -1, np.int32), np.zeros(len(a), np.int64), fp[a], fp[b])

    return run


def links(distinct: DataFrame, radius: int, split: int = SPLIT) -> DataFrame:
    """Links (fp, fp_b) that connect exactly the fingerprints (column fp, all different) within the radius of each other."""
    masks = covering_masks(radius)
    n = distinct.count() * len(masks)
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(masks)]))
    dealt = distinct.select(cells.alias("cell"), "fp").select("cell.tab", "cell.key", "fp")
    parts = hash_parts(distinct, n, PER_TASK)
    first = staged(dealt.repartition(parts, "tab", "key").mapInArrow(_bucket_links(radius, split), CELLS), "buckets")
    finer = [F.struct(F.lit(v).alias("tab"), F.lit(_signed(m | p)).alias("mask")) for v, m in enumerate(masks) for p in _parts(m, radius + 1)]
    large = first.where("tab >= 0").join(distinct.sparkSession.range(1).select(F.explode(F.array(*finer)).alias("x")).select("x.tab", "x.mask"), "tab")
    cell = F.pmod(F.xxhash64("tab", "mask"), F.lit((1 << 31) - 1)).cast("int")
    again = large.select(cell.alias("tab"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    second = again.repartition(parts, "tab", "key").mapInArrow(_bucket_links(radius, None), CELLS)
    return first.where("tab < 0").unionByName(second.where("tab < 0")).select("fp", "fp_b")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """Per document: doc_id, row mark, fp, and the root of its component; fingerprints link within ``radius`` bits."""
    rows = staged(fingerprints(docs, words), "fingerprints")
    distinct = staged(rows.select("fp").distinct(), "distinct")
    found = components(links(distinct, radius).select(F.col("fp").alias("a"), F.col("fp_b").alias("b")))
    return rows.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", ROW, "fp", F.coalesce("root", "fp").alias("root"))


def with_components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (smallest doc_id that can be reached)."""
    rows = near_duplicates(docs, words, radius)
    lowest = staged(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "lowest")  # a plain side, so that the join can be split
    return rows.join(lowest, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
