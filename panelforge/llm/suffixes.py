"""Removal of repeated byte strings through merged Burrows-Wheeler transforms of shards.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else (other documents or the same one).

1. Every window of ``length`` bytes is named after the smallest hash of its 64-byte grams; equal windows share name and offset. Neighbouring
   windows with the same smallest gram form a run. Runs whose gram occurs once are free of repeats and leave here, which is most of the text.
2. Equal runs are folded into one with a count. Runs met at least twice are repeated as a whole. What has to be decided is left:
   runs that occur once but share their gram with other runs.
3. The bytes of those runs are dealt out by gram; each task reads them ordered by gram and holds some whole grams at a time, in shards of bounded size. For a
   shard the suffix order and its Burrows-Wheeler transform (over blocks of length/8 bytes) are built. All shards held are then merged by
   refining their interleave: one stable bucket pass over the transforms per block depth orders all suffixes by one block more;
   only shard numbers move, suffixes are not sorted again. A boundary that appears in pass k tells a common prefix of k - 1 blocks; ranges without a
   boundary after the last pass are repeated intervals.
4. Repeated windows go back to all runs that share the bytes; ranges are united per document.

A gram with more than ``HOT`` different runs is split: windows are dealt by the bytes they hold (32 windows by their common
core, then single windows), so a passage shared by a third of all documents has no task of its own.

Defined results: null text is empty text; a text shorter than ``length`` loses nothing; repeated rows are documents of their own
and lose what they share; null ids are allowed; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.staging import releasing, staged
from panelforge.llm.common import ROW, hash_parts, row_apart, slices, whole, with_row

LENGTH = 400
GRAM = 64
DEPTH = 8
BLOCK = 1 << 18
SHARD = 1 << 16
MERGE_BYTES = 1 << 18
TASK_BYTES = 1 << 20
HOT = 4000
CORE = 32
_RNG = np.random.default_rng(20240607)
_TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_S = np.uint64(31)
_BASE, _BACK = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> _S)) * _M[0] + b
    return (x ^ (x >> _S)) * _M[1]


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes, by doubling and one overlapping step."""
    h, n = _TABLE[data], 1
    while 2 * n <= size:
        h = _mix(h[:-n], h[n:])
        n *= 2
    return h if n == size else _mix(h[: len(h) - (size - n)], h[size - n :])


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


class Ranges:
    """Hashes of arbitrary ranges of a byte array through sums of gram hashes."""

    fore, back = _powers(2 * BLOCK, _BASE), _powers(2 * BLOCK, _BACK)

    def __init__(self, gram: np.ndarray) -> None:
        self.sums = np.r_[np.uint64(0), np.cumsum(gram * self.fore[: len(gram)])]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes from start to end, at least one gram long."""
        last = end - GRAM + 1
        x = (self.sums[last] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * _M[2]
        return (x ^ (x >> _S)) * _M[1]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Blocks of about BLOCK bytes: parts (document, offset in it, place in the block); long texts overlap by length - 1 bytes."""
    parts, held, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), BLOCK):
            piece = t[at : at + BLOCK + length - 1]
            if parts and size + len(piece) > BLOCK:
                yield parts, b"".join(held)
                parts, held, size = [], [], 0
            parts.append((i, at, size))
            held.append(piece)
            size += len(piece)
    if parts:
        yield parts, b"".join(held)


def runs_of_block(parts: list[tuple[int, int, int]], data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Document, gram hash, hash of the run's bytes, and first window, last window and gram, as offsets in the document."""
    raw = np.frombuffer(data, np.uint8)
    g = grams(raw, GRAM)
    width, low = length - GRAM + 1, np.uint64((1 << 20) - 1)
    m = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    n = 1
    while 2 * n <= width:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    if n < width:
        m = np.minimum(m[: len(m) - (width - n)], m[width - n :])
    at = (m & low).astype(np.int64)  # of the smallest gram, the leftmost of equal ones, for every window
    places = np.array([p for *_, p in parts])
    ends = np.r_[places[1:], len(raw)]
    owner = np.searchsorted(places, np.arange(len(at)), side="right") - 1
    inside = np.arange(len(at)) + length <= ends[owner]
    new = np.r_[True, (at[1:] != at[:-1]) | ~inside[:-1] | (owner[1:] != owner[:-1])] & inside
    first = np.flatnonzero(new)
    stop = np.flatnonzero(np.r_[(~inside[1:]) | new[1:], True] & inside)
    ranges, own = Ranges(g), owner[first]
    shift = np.array([o for _, o, _ in parts])[own] - places[own]
    anchor = at[first]
    full = _mix(ranges.hash(first, stop + length), (anchor - first).astype(np.uint64))
    return np.array([i for i, *_ in parts])[own], g[anchor].view(np.int64), full.view(np.int64), first + shift, stop + shift, anchor + shift


RUNS = f"`{ROW}` long, gram long, bytes long, first int, last int, anchor int"


def runs(docs: DataFrame, length: int) -> DataFrame:
    names = [part.split()[0].strip("`") for part in RUNS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            rows = batch.column(ROW).to_numpy()
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            for parts, data in _pieces(texts, length):
                doc, gram, full, first, last, anchor = runs_of_block(parts, data, length)
                cols = [pa.array(rows[doc]), pa.array(gram), pa.array(full), *(pa.array(c.astype(np.int32)) for c in (first, last, anchor))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, RUNS)


def bodies(docs: DataFrame, picked: DataFrame, length: int) -> DataFrame:
    """The bytes of picked runs (row, gram, bytes, first, last, anchor, n)."""
    by_row = picked.groupBy(ROW).agg(F.collect_list(F.struct("gram", "bytes", "first", "last", "anchor", "n")).alias("runs"))
    body = F.substring(F.col("data"), F.col("r.first") + 1, F.col("r.last") - F.col("r.first") + length)
    joined = docs.join(by_row, ROW).select(F.col("text").cast("binary").alias("data"), F.explode("runs").alias("r"))
    return joined.select("r.gram", "r.bytes", (F.col("r.anchor") - F.col("r.first")).alias("back"), "r.n", body.alias("body"))


class Shard:
    """Suffix order and transform of some byte strings, over block names that all shards of a merge share."""

    def __init__(self, names: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        rank, step = names, 1
        hop = after
        while step < DEPTH:
            pair = rank.astype(np.uint64) << np.uint64(32) | rank[hop].astype(np.uint64)
            rank = np.unique(pair, return_inverse=True)[1]
            hop, step = hop[hop], 2 * step
        self.order = np.argsort(rank, kind="stable")
        self.transform = names[before[self.order]]


def interleave(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the shard that each place of the merged order takes its next suffix from, and common prefixes in blocks."""
    symbols = np.concatenate([s.transform for s in shards]).astype(np.uint64)
    source = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(s.order) for s in shards])
    n = len(source)
    common = np.full(n, DEPTH, np.int8)
    common[:1] = 0
    group = np.zeros(n, np.int64)
    place = np.arange(n, dtype=np.uint64)
    for depth in range(DEPTH):
        bucket = np.empty(n, np.uint64)
        bucket[np.argsort(source, kind="stable")] = symbols
        key = np.sort(bucket << np.uint64(32) | place)  # a stable pass over the symbols
        moved = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        key >>= np.uint64(32)
        source, old = source[moved], group[moved]
        new = np.r_[True, (key[1:] != key[:-1]) | (old[1:] != old[:-1])]
        common[new & (common == DEPTH)] = depth
        group = np.cumsum(new)
    return source, common


def repeated_windows(strings: list[bytes], length: int, shard_bytes: int = SHARD) -> list[np.ndarray]:
    """For every string, which of its windows of ``length`` bytes start more than once in all strings."""
    step = length // DEPTH
    sizes = np.array([len(s) + step for s in strings])
    starts = np.r_[0, np.cumsum(sizes)]
    raw = np.frombuffer(b"".join(s + bytes(step) for s in strings), np.uint8)
    n = len(raw)
    owner = np.repeat(np.arange(len(strings)), sizes)
    place = np.arange(n)
    hashes = np.zeros(n, np.uint64)
    hashes[: n - step + 1] = grams(raw, step)
    ended = place + 2 * step > starts[owner + 1]  # blocks that touch the end marks: each a name of its own
    names = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    names[ended] = names.max() + 1 + np.arange(ended.sum())
    before = place - step
    before += np.where(before < starts[owner], sizes[owner], 0)
    after = place + step
    after -= np.where(after >= starts[owner + 1], sizes[owner], 0)
    cuts, held = [0], 0
    for i, size in enumerate(sizes):
        held += size
        if held >= shard_bytes or i == len(sizes) - 1:
            cuts.append(i + 1)
            held = 0
    bounds = [(starts[a], starts[b]) for a, b in zip(cuts, cuts[1:])]
    shards = [Shard(names[a:b], before[a:b] - a, after[a:b] - a) for a, b in bounds]
    source, common = interleave(shards)
    repeated = common == DEPTH  # continues the interval of the place before
    repeated[:-1] |= repeated[1:]
    merged = np.empty(n, np.int64)
    merged[np.argsort(source, kind="stable")] = np.concatenate([s.order + a for s, (a, _) in zip(shards, bounds)])
    flags = np.zeros(n, bool)
    flags[merged] = repeated
    return [flags[a : a + max(len(s) - length + 1, 0)] for a, s in zip(starts, strings)]


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every run of true values."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


FOUND = "gram long, bytes long, spans array<struct<a:int,b:int>>"


def whole_grams(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows ordered by gram, cut where the gram changes, as soon as ``limit`` bytes of bodies are held. A gram is never cut."""
    held, size, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        gram = batch.column("gram").to_numpy()
        sizes = np.cumsum(pc.binary_length(batch.column("body")).to_numpy())
        start = 0
        for at in np.flatnonzero(np.r_[gram[0] != last, gram[1:] != gram[:-1]]).tolist():
            before = int(sizes[at - 1]) if at else 0
            done = int(sizes[start - 1]) if start else 0
            if size + before - done >= limit:
                held.append(batch.slice(start, at - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, at
        held.append(batch.slice(start))
        size += int(sizes[-1]) - (int(sizes[start - 1]) if start else 0)
        last = gram[-1]
    if held:
        yield pa.Table.from_batches(held)


def decide(held: DataFrame, length: int, limit: int = MERGE_BYTES) -> DataFrame:
    """gram, bytes and spans of repeated windows (offsets from the run's first one) of runs that occur once; rows come ordered by gram."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_grams(batches, limit):
            flags = repeated_windows(rows.column("body").to_pylist(), length)
            spans = [[{"a": a, "b": b} for a, b in zip(*(x.tolist() for x in _spans(f)))] if n == 1 else [] for f, n in zip(flags, rows.column("n").to_pylist())]
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            out = pa.table([rows.column("gram"), rows.column("bytes"), pa.array(spans, kind)], names=["gram", "bytes", "spans"])
            yield from out.filter(pa.array([bool(s) for s in spans])).to_batches()

    return held.mapInArrow(run, FOUND)


SUBRUNS = "gram long, bytes long, n long, part int, core long, whole long, a int, b int"


def subruns(held: DataFrame, length: int, size: int) -> DataFrame:
    """Windows of runs, ``size`` by ``size`` in their distance from the gram: hash of their common core and of all their bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[] for _ in range(8)]
            for gram, full, back, n, body in zip(*(batch.column(c).to_pylist() for c in ("gram", "bytes", "back", "n", "body"))):
                hashed = Ranges(grams(np.frombuffer(body, np.uint8), GRAM))
                part = (back - np.arange(len(body) - length + 1)) // size
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                last = np.r_[first[1:], len(part)] - 1
                part = part[first]
                nearest = back - part * size  # the window of the part that is nearest to the gram, whether in this run or not
                mark = _mix(np.full(len(part), gram, np.int64).view(np.uint64), part.astype(np.uint64))
                core = _mix(hashed.hash(nearest, nearest - size + 1 + length), mark).view(np.int64)
                entire = _mix(hashed.hash(first, last + length), mark + (nearest - first).astype(np.uint64) * _M[2]).view(np.int64)
                k = len(part)
                for col, values in zip(cols, ([gram] * k, [full] * k, [n] * k, part, core, entire, first, last)):
                    col.extend(values)
            kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in SUBRUNS.split(", ")])

    return held.mapInArrow(run, SUBRUNS)


def decide_hot(held: DataFrame, length: int) -> DataFrame:
    """Like ``decide`` for grams with very many different runs, by counting parts of runs and then single windows."""
    parts = staged(subruns(held, length, CORE), "parts")
    same = parts.groupBy("core", "whole").agg(F.sum("n").alias("same"))
    share = same.groupBy("core").agg(F.sum("same").alias("share")).where("share > 1")
    told = staged(parts.join(same, ["core", "whole"]).join(share, "core").where("n = 1"), "told")
    done = told.where("same > 1").select("gram", "bytes", "a", "b")
    open_runs = told.where("same = 1").select("gram", "bytes", "core").distinct()
    wanted = told.where("same = 1").select("core").distinct()
    touched = parts.join(wanted, "core", "left_semi").select("gram", "bytes").distinct()
    single = staged(subruns(held.join(touched, ["gram", "bytes"], "left_semi"), length, 1), "windows")
    often = single.groupBy("whole").agg(F.sum("n").alias("same")).where("same > 1").select("whole")
    windows = single.where("n = 1").join(often, "whole", "left_semi").join(open_runs.select("gram", "bytes").distinct(), ["gram", "bytes"], "left_semi")
    found = done.unionByName(windows.select("gram", "bytes", "a", "b"))
    return found.groupBy("gram", "bytes").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def repeats(docs: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """row, spans: byte ranges (start, stop) covered by repeated strings, not united yet; ``docs`` has the row mark and the text."""
    found = staged(runs(docs, length), "runs")
    often = staged(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "often")  # a plain side, so that the join can be split
    shared = staged(found.join(often, "gram", "left_semi"), "shared")
    one = F.min(F.struct(ROW, "first", "last", "anchor")).alias("one")
    groups = staged(shared.groupBy("gram", "bytes").agg(F.count("*").alias("n"), one), "groups")
    by_gram = groups.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1")
    picked = groups.join(by_gram.select("gram", "kinds"), "gram").select("gram", "bytes", "n", "kinds", f"one.{ROW}", "one.first", "one.last", "one.anchor")
    held = staged(bodies(docs, picked, length).join(by_gram.select("gram", "kinds"), "gram"), "bodies")
    size, hottest = held.agg(F.coalesce(F.sum(F.length("body")), F.lit(0)), F.coalesce(F.max("kinds"), F.lit(0))).first()
    dealt = held.where(F.col("kinds") <= hot).select("gram", "bytes", "n", "body").repartition(hash_parts(docs, size, TASK_BYTES), "gram")
    decided = decide(dealt.sortWithinPartitions("gram"), length)
    if hottest > hot:
        decided = decided.unionByName(decide_hot(held.where(F.col("kinds") > hot), length))
    all_of_it = F.array(F.struct(F.lit(0).alias("a"), (F.col("last") - F.col("first")).alias("b")))
    total = shared.join(groups.where("n > 1").select("gram", "bytes"), ["gram", "bytes"]).select(ROW, "first", all_of_it.alias("spans"), "last")
    partly = shared.join(decided, ["gram", "bytes"]).select(ROW, "first", "spans", "last")
    windows = total.select(ROW, "first", "spans").unionByName(partly.select(ROW, "first", "spans"))
    ranges = F.transform("spans", lambda x: F.struct((F.col("first") + x["a"]).alias("start"), (F.col("first") + x["b"] + length).alias("stop")))
    return windows.select(ROW, ranges.alias("ranges")).groupBy(ROW).agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def _cutter(words: int):
    return lambda batches: _cut(batches, words)


def _cut(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in slices(batches, "text", 4 << 20):
        sizes, removed, kept = [], [], []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
            data = text.encode()
            spans, out, at = [], [], 0
            for start, stop in sorted((r["start"], r["stop"]) for r in ranges or ()):
                if spans and start <= spans[-1]["stop"]:
                    spans[-1]["stop"] = max(spans[-1]["stop"], stop)
                else:
                    spans.append({"start": start, "stop": stop})
            if words:
                spans = [s for s in spans if len(data[s["start"] : s["stop"]].split()) > words]
            for s in spans:
                out.append(data[at : s["start"]])
                at = s["stop"]
            out.append(data[at:])
            sizes.append(len(data))
            removed.append(spans)
            kept.append(b"".join(out))
        left = [k.decode("utf-8", "ignore") if r else None for k, r in zip(kept, removed)]
        cols = [pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary()), pa.array(left, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *cols], names=["doc", "n_bytes", "removed", "kept", "left"])


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, words: int = 0) -> DataFrame:
    """For every row of ``docs``: ``doc`` (its columns but the text), n_bytes, the spans removed (start, stop), the bytes kept, and
    ``left``, the text of those without characters cut in half, or null if nothing was removed. Spans of ``words`` words or fewer stay."""
    if length % DEPTH or length < 2 * GRAM:
        raise ValueError(f"length must be a multiple of {DEPTH}, {2 * GRAM} at least")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    texts = with_row(docs).select(ROW, F.struct(*others).alias("doc"), whole().alias("text"))
    with releasing(docs.sparkSession):
        spans = staged(repeats(texts.select(ROW, "text"), length, hot), "spans", keep=True)
    marked = texts.join(spans, ROW, "left").select("doc", "text", "ranges")
    kind = dict(texts.dtypes)["doc"]
    return marked.mapInArrow(_cutter(words), f"doc {kind}, n_bytes long, removed array<struct<start:int,stop:int>>, kept binary, left string")


@row_apart
def shortened(docs: DataFrame, length: int, words: int = 0) -> DataFrame:
    """The rows of ``docs`` with the text that is left; n_chars, if there, follows. A text without repeats stays as it is."""
    named = {c: F.col(f"doc.`{c}`") for c in docs.columns if c != "text"}
    if "n_chars" in named:
        named["n_chars"] = F.when(F.size("removed") > 0, F.length("left")).otherwise(named["n_chars"]).cast(docs.schema["n_chars"].dataType)
    nothing = F.when(F.col("n_bytes") > 0, F.col("kept").cast("string"))
    text = F.when(F.size("removed") > 0, F.col("left")).otherwise(nothing)
    return without_repeats(docs, length, words=words).select(*[(text if c == "text" else named[c]).alias(c) for c in docs.columns])


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    cut = without_repeats(docs.select(F.col("doc_id").cast("long"), "text"), length)
    return cut.select(
        "doc.doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
