"""Near copies by the exact Jaccard similarity of word shingles, with covering SimHash tables for the bulk of them.

Two documents link if the sets of their shingles have a similarity of ``SHARE`` at least; groups are the components of those links.

1. Every shingle gets its exact document count. Shingles are counted where their hash belongs, from sorted blocks of a slice of texts; one that stands in ``LOCAL``
   documents of a slice travels once with its count. Only shingles of two documents or more come back to their slice.
2. Shingles stand in one global order, rarest first. Two sets of n and m that link share one within the first n - ceil(0.8 n) + 1 (and m alike), whatever
   the order. So a document whose shingles of its own fill that prefix has no partner and leaves here; the others deal out what their prefix holds beside.
3. Candidates: fingerprints (``simhash``) of those documents that a covering table brings together; all pairs of a shingle's rows where these
   are ``SMALL`` or fewer, and all with one hub where they are more. A pair has to be able to reach the overlap the similarity asks for: by the
   place of the shared shingle in both orders, and by a parity bitmap (bits that differ in it are a lower bound of the shingles that only one has).
   Neither leaves out a link.
4. Candidates are verified on the whole sets. Only verified pairs link.
5. Rows of a large bucket that are in another component than the hub after that are compared with all rows of the bucket in other components, in blocks of
   ``BLOCK`` rows. After this every pair that can link was compared or is connected.

Shingles and sets are named by 64-bit hashes. Defined results: a text of fewer words than a shingle is one shingle; texts without words are copies of each
other; null text is empty; repeated rows are documents of their own; null ids are larger than all others; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.staging import releasing, staged
from panelforge.llm import simhash
from panelforge.llm.common import ROW, hash_parts, row_apart, slices, whole, with_row
from panelforge.llm.components import components

#: Similarity from which documents link, as a fraction.
SHARE = (4, 5)
#: Bits in which linked fingerprints may differ.
RADIUS = 2
PER_TASK = 400_000  # shingles
SLICE = 4 << 20
LOCAL = 8
SMALL = 8
BLOCK = 2048
MANY = 0xFFFF  # in place of a document's number in its slice: all that the slice itself remembers
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
_BITS = [f"b{i}" for i in range(4)]


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted hashes of the different shingles of a text."""
    w = text.lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    k = min(words, len(w))
    if not k:
        return h
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = (s ^ (s >> _SHIFT)) * _MIX + h[i : len(h) - k + 1 + i]
    return np.unique((s ^ (s >> _SHIFT)) * _MIX)


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Shared shingles that sets of n and m need to link."""
    p, q = SHARE
    return -(-p * (n + m) // (p + q))


def _name(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype(np.int64))


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Shingles of which a linked set has to share one, in any global order."""
    p, q = SHARE
    return np.where(n > 0, n + (-p * n // q) + 1, 0)


def _parity(found: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((found & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1, bitorder="little").view(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte by byte of all, so that shuffle compression finds the zeros."""
    return np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


#: Rows between the steps. kind 0: a document. 1: shingles of a slice (``h``), with the document's number or MANY (``who``), and counts of the MANY ones (``more``).
#: 2: what a slice remembers of its MANY shingles: ``h``, their counts (``more``), and the documents' numbers (``who``).
ROWS = f"kind int, part int, slice long, doc int, doc_id long, `{ROW}` long, node long, n int, " + ", ".join(f"{b} long" for b in _BITS) + ", h binary, who binary, more binary"
_SCHEMA = pa.schema([(c.split()[0].strip("`"), {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in ROWS.split(", ")])


def _row_batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _sliced(words: int, parts: int):
    """Texts -> documents and their shingles, by part of the hash range."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, MANY):
                for batch in slices([whole_batch.slice(start, MANY)], "text", SLICE):
                    found = [shingles(t.encode(), words) for t in batch.column("text").to_pylist()]
                    sizes, k = np.array([len(f) for f in found]), len(found)
                    mark = batch.column(ROW)[0].as_py()
                    bits = np.array([_parity(f) for f in found]).T
                    docs = {"kind": [0] * k, "part": [mark % parts] * k, "slice": [mark] * k, "doc": range(k), "doc_id": batch.column("doc_id"), ROW: batch.column(ROW), "node": [_name(f) for f in found], "n": sizes}
                    yield _row_batch(docs | dict(zip(_BITS, bits)), k)
                    h, who = np.concatenate(found), np.repeat(np.arange(k), sizes).astype("<u2")
                    del found
                    order = np.argsort(h, kind="stable")
                    h, who = h[order], who[order]
                    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                    count = np.diff(np.r_[first, len(h)])
                    hot = np.repeat(count >= LOCAL, count)
                    if hot.any():
                        many = {"kind": [2], "part": [mark % parts], "slice": [mark], "h": [_packed(h[first[count >= LOCAL]])], "who": [who[hot].tobytes()], "more": [count[count >= LOCAL].astype("<u4").tobytes()]}
                        yield _row_batch(many, 1)
                    sent = ~hot
                    sent[first] = True
                    who = np.where(hot, MANY, who).astype("<u2")[sent]
                    more = np.repeat(count, count)[sent]
                    h = h[sent]
                    part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(h) else np.zeros(1, np.int64)
                    cells = list(zip(cuts[:-1], cuts[1:]))
                    cols = {"kind": [1] * len(cells), "part": [part[a] for a, _ in cells], "slice": [mark] * len(cells), "h": [_packed(h[a:b]) for a, b in cells], "who": [who[a:b].tobytes() for a, b in cells]}
                    cols["more"] = [more[a:b][who[a:b] == MANY].astype("<u4").tobytes() for a, b in cells]
                    yield _row_batch(cols, len(cells))

    return run


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of whole parts -> those of two documents or more, with their counts (``more``); all else unchanged."""
    h, who, count, owner, marks = [], [], [], [], []
    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        if (kind != 1).any():
            yield batch.filter(pa.array(kind != 1))
        for i in np.flatnonzero(kind == 1):
            row = [batch.column(c)[int(i)].as_py() for c in ("h", "who", "more", "slice")]
            h.append(_unpacked(row[0]))
            who.append(np.frombuffer(row[1], "<u2"))
            c = np.ones(len(who[-1]), np.int64)
            c[who[-1] == MANY] = np.frombuffer(row[2], "<u4")
            count.append(c)
            owner.append(np.full(len(c), len(marks), np.int32))
            marks.append(row[3])
    if not h:
        return
    h, who, count, owner = map(np.concatenate, (h, who, count, owner))
    order = np.argsort(h, kind="stable")
    total = np.zeros(len(h), np.int64)
    first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    total[order] = np.repeat(np.add.reduceat(count[order], first), np.diff(np.r_[first, len(h)]))
    often = np.flatnonzero(total > 1)  # still by slice, since blocks were read one after the other
    cuts = np.flatnonzero(np.r_[True, owner[often][1:] != owner[often][:-1], True]) if len(often) else np.zeros(1, np.int64)
    for i in range(0, len(cuts) - 1, 512):
        cells = [often[a:b] for a, b in zip(cuts[i : i + 512], cuts[i + 1 : i + 513])]
        cols = {"kind": [1] * len(cells), "slice": [marks[owner[c[0]]] for c in cells], "h": [_packed(h[c]) for c in cells], "who": [who[c].tobytes() for c in cells]}
        yield _row_batch(cols | {"more": [np.minimum(total[c], (1 << 32) - 1).astype("<u4").tobytes() for c in cells]}, len(cells))


POSTINGS = "shingle long, node long, n int, pos int, " + ", ".join(f"{b} long" for b in _BITS) + ", docs long"


def _prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole slices -> the repeated shingles in the prefix of every document that can have a partner."""
    held: dict[int, list] = {}
    for batch in batches:
        for i, (kind, mark) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("slice").to_pylist())):
            at = held.setdefault(mark, [[], [], []])
            if kind:
                at[kind].append([batch.column(c)[i].as_py() for c in ("h", "who", "more")])
            else:
                at[0].append([batch.column(c)[i].as_py() for c in ("doc", "node", "n", *_BITS)])
    for docs, back, own in held.values():
        docs = np.array(sorted(docs), np.int64)
        if not back or not len(docs):
            continue
        h = np.concatenate([_unpacked(b[0]) for b in back])
        who = np.concatenate([np.frombuffer(b[1], "<u2") for b in back])
        total = np.concatenate([np.frombuffer(b[2], "<u4") for b in back]).astype(np.int64)
        if own:
            hot = who == MANY
            order = np.argsort(h[hot])
            one_h, one_total = h[hot][order], total[hot][order]
            own_h, own_count, own_who = _unpacked(own[0][0]), np.frombuffer(own[0][2], "<u4"), np.frombuffer(own[0][1], "<u2")
            all_h = np.repeat(own_h, own_count)
            h, who = np.r_[h[~hot], all_h], np.r_[who[~hot], own_who]
            total = np.r_[total[~hot], one_total[np.searchsorted(one_h, all_h)]]
        order = np.lexsort((h, total, who))
        h, who, total = h[order], who[order].astype(np.int64), total[order]
        n = docs[:, 2]
        repeated = np.bincount(who, minlength=len(docs))
        wanted = np.maximum(prefix_size(n) - (n - repeated), 0)
        place = np.arange(len(who)) - np.r_[0, np.cumsum(repeated)][who]
        take = np.flatnonzero(place < wanted[who])
        who, pos = who[take], (n - repeated)[who[take]] + place[take]
        cols = [h[take].view(np.int64), docs[who, 1], n[who].astype(np.int32), pos.astype(np.int32), *(docs[who, 3 + b] for b in range(4)), total[take]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[c.split()[0] for c in POSTINGS.split(", ")])


def able(x: dict, y: dict):
    """Whether two rows of a bucket can still reach the similarity; for columns as for arrays."""
    p, q = SHARE
    total = x["n"] + y["n"]
    reach = lambda v: (v["n"] - v["pos"]) * (p + q) >= p * total
    if isinstance(x["n"], Column):
        differ = sum((F.bit_count(x[b].bitwiseXOR(y[b])) for b in _BITS), F.lit(0))
    else:
        differ = sum(np.bitwise_count((x[b] ^ y[b]).view(np.uint64)).astype(np.int64) for b in _BITS)
    return reach(x) & reach(y) & ((total - differ) * (p + q) >= 2 * p * total)


_FIELDS = ("shingle", "node", "n", "pos", *_BITS)


def _columns(batches: Iterable[pa.RecordBatch], fields: tuple[str, ...]) -> dict[str, np.ndarray] | None:
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    return {c: np.concatenate([b.column(c).to_numpy() for b in held]).astype(np.int64) for c in fields}


def _pair_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole small buckets -> candidate pairs."""
    rows = _columns(batches, _FIELDS)
    if rows is None:
        return
    order = np.lexsort((rows["node"], rows["shingle"]))
    rows = {c: v[order] for c, v in rows.items()}
    new = np.r_[True, (rows["shingle"][1:] != rows["shingle"][:-1]) | (rows["node"][1:] != rows["node"][:-1])]
    rows = {c: v[new] for c, v in rows.items()}
    for step in range(1, SMALL):
        x, y = ({c: v[s] for c, v in rows.items()} for s in (slice(None, -step), slice(step, None)))
        if not len(x["n"]):
            break
        fits = (x["shingle"] == y["shingle"]) & able(x, y)
        yield _pair_batch([x["node"][fits]], [y["node"][fits]])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole pairs of blocks of large buckets -> candidate pairs between the asking rows (role 0) and others of another root."""
    rows = _columns(batches, (*_FIELDS, "root", "role", "i", "j"))
    if rows is None:
        return
    order = np.lexsort((rows["role"], rows["j"], rows["i"], rows["shingle"]))
    rows = {c: v[order] for c, v in rows.items()}
    key = np.r_[True, np.any([rows[c][1:] != rows[c][:-1] for c in ("shingle", "i", "j")], axis=0), True]
    a, b, held = [], [], 0
    for start, stop in zip(np.flatnonzero(key)[:-1], np.flatnonzero(key)[1:]):
        split = start + int(np.searchsorted(rows["role"][start:stop], 1))
        others = {c: v[split:stop] for c, v in rows.items()}
        for at in range(start, split):
            one = {c: v[at : at + 1] for c, v in rows.items()}
            fits = able(one, others) & (others["root"] != one["root"])
            b.append(others["node"][fits])
            a.append(np.full(len(b[-1]), one["node"][0]))
            held += len(b[-1])
        if held > 1 << 18:
            yield _pair_batch(a, b)
            a, b, held = [], [], 0
    yield _pair_batch(a, b)


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = batch.columns
        near = []
        for s, t in zip(x, y):
            s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (s, t))
            near.append(len(np.intersect1d(s, t, assume_unique=True)) >= int(needed(len(s), len(t))))
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(near, pa.bool_()))


def whole_sets(texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, its set and its fingerprint for the documents named by ``nodes`` (node, row mark)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            cols = [batch.column("node"), pa.array([shingles(t, words).tobytes() for t in texts], pa.binary()), pa.array([simhash.fingerprint(t, words, True) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "bytes", "fp"])

    return texts.join(nodes, ROW).select("node", "text").mapInArrow(run, "node long, bytes binary, fp long")


def covered(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints a covering table brings together; equal fingerprints meet in one of them."""
    first = staged(sets.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    near = simhash.links(first.select("fp"), RADIUS)
    across = near.join(first.withColumnRenamed("first", "a"), "fp").join(first.select(F.col("fp").alias("fp_b"), F.col("first").alias("b")), "fp_b").select("a", "b")
    return across.union(sets.select("node", "fp").join(first, "fp").where("node != first").select("first", "node"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets have the similarity, by the whole sets."""
    pairs = staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "candidates")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("bytes").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("bytes").alias("y")), "b")
    return staged(both.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long"), "verified")


def links(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between sets that connect exactly those with the similarity."""
    n = postings.count()
    few = postings.where(F.col("docs") <= SMALL).repartition(hash_parts(postings, n, PER_TASK), "shingle").mapInArrow(_small, "a long, b long")
    large = staged(postings.where(F.col("docs") > SMALL).select(*_FIELDS).distinct(), "large")
    hubs = staged(large.groupBy("shingle").agg(F.min(F.struct("node", "n", "pos", *_BITS)).alias("hub")), "hubs")  # a plain side, so that the join can be split
    met = large.join(hubs, "shingle").where(F.col("node") != F.col("hub.node"))
    met = met.where(able({c: F.col(c) for c in ("n", "pos", *_BITS)}, {c: F.col(f"hub.{c}") for c in ("n", "pos", *_BITS)}))
    found = verified(covered(sets).union(few).union(met.select("node", "hub.node")), sets)

    roots = components(found).withColumnRenamed("root", "r")
    rooted = staged(large.join(roots, "node", "left").select(*_FIELDS, F.coalesce("r", "node").alias("root")), "rooted")
    mixed = rooted.groupBy("shingle").agg(F.min_by("root", "node").alias("hub"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).where("low != high")
    rows = rooted.join(staged(mixed.select("shingle", "hub", "m"), "mixed"), "shingle")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    asking = rows.where("root != hub").select(*_FIELDS, "root", F.lit(0).alias("role"), mine.alias("i"), every.alias("j"))
    asked = rows.select(*_FIELDS, "root", F.lit(1).alias("role"), every.alias("i"), mine.alias("j"))
    dealt = staged(asking.union(asked), "dealt")
    more = dealt.repartition(hash_parts(postings, dealt.count(), PER_TASK // 4), "shingle", "i", "j").mapInArrow(_blocks, "a long, b long")
    return found.union(verified(more, sets))


def groups(texts: DataFrame, words: int) -> DataFrame:
    """doc_id, row mark and root of the group for every row of ``texts`` (doc_id, row mark, text)."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = hash_parts(texts, size // 6, PER_TASK)
    kept = staged(texts.mapInArrow(_sliced(words, parts), ROWS).repartition(parts, "part").mapInArrow(_counted, ROWS), "counted")
    rows = kept.where("kind = 0").select("doc_id", ROW, "node")
    needed_rows = kept.select("kind", "slice", "doc", "node", "n", *_BITS, "h", "who", "more")
    postings = staged(needed_rows.repartition(parts, "slice").mapInArrow(_prefixes, POSTINGS), "postings")
    able_nodes = staged(postings.select("node").distinct(), "nodes")
    first = rows.join(able_nodes, "node").groupBy("node").agg(F.min(ROW).alias(ROW))
    sets = staged(whole_sets(texts, staged(first, "first"), words), "sets")
    found = components(links(postings, sets))
    return rows.join(found, "node", "left").select("doc_id", ROW, F.coalesce("root", "node").alias("root"))


@row_apart
def representatives(docs: DataFrame, words: int) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their group of near copies, with all their columns."""
    marked = with_row(docs)
    texts = marked.select(F.col("doc_id").cast("long").alias("doc_id"), ROW, whole().alias("text"))
    with releasing(docs.sparkSession):
        rooted = staged(groups(texts, words), "roots")
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first")
        best = rooted.groupBy("root").agg(first).select(F.col(f"first.{ROW}").alias(ROW))
        gone = staged(rooted.select(ROW).join(best, ROW, "left_anti"), "gone", keep=True)
    return marked.join(gone, ROW, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
