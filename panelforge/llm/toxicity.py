"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two strings compares their subsequences of three symbols (letters without case, digits, word end) within a span of ``SPAN``: a
subsequence weighs ``DECAY`` to the number of symbols that it skips, and the sum of products is divided by the norms. Punctuation is only skipped. So a word with inserted
characters shares most of its subsequences with the plain word, at a lower weight.

Strings are the words of a text with all their marks ("st*upid", "i.d.i.o.t"); neighbouring words of one or two characters are one string together, so that spaced-out
words ("i d i o t") stay whole; strings of more than ``LONG`` symbols are cut into overlapping parts. A document is told by its highest value, and by
the sum and the mean of what its strings have above ``CLEAR``.

Learning: labelled documents are cut into sentences that inherit the label, equal sentences of a class count once (copies of a document add nothing), and every
string weighs as many sentences as hold it, per class. Landmarks, half the strings that stand out most in toxic sentences and half others by hash, span a Nyström map
of the kernel; a support vector machine (squared hinge, primal Newton steps) is fitted in it, and a logistic curve over these three figures, fitted on documents that
the machine has not seen, gives the score. The kernel is an inner product over 32 * 32 * 32 subsequences, so landmarks, map and machine fold into one
weight per subsequence: only this table (128 KB) travels, and texts are scored where they lie, each different string once per task.

Learning uses a bounded sample: per class and part ``MAX_DOCS`` labelled documents of the learning fold with the smallest hashes, and of their strings the ``UNITS`` that
weigh most. Counts of labels are those of all labels of the learning fold.

Defined results: null text is empty text; a text without words has the value of a string that shares nothing; without labels of both classes every score is the
share of toxic labels (0 without labels); labels that are null are not learned; a document with several labels is learned once for each; repeated rows are
scored alike; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.staging import staged
from panelforge.llm.common import slices, whole

SPAN, DECAY = 7, 0.6
LONG = 32
MAX_DOCS = 4000
UNITS = 60_000
LANDMARKS = 200
MISFIT = 5000.0  # weight of all hinge losses of a class against the norm
CLEAR = 0.3  # value from which a string counts in the document's sum
SYMBOLS = 32
MARK = 28  # spaces and punctuation inside a string: skipped like any symbol, never part of a subsequence
KNOWN = 400_000  # strings a task remembers
BATCH = 256
GAPS = tuple((a, b) for b in range(2, SPAN) for a in range(1, b))
_WEIGHTS = np.array([DECAY ** (b - 2) for _, b in GAPS] + [0.0])
_NONE = SYMBOLS**3  # in place of a symbol: no subsequence
_SENTENCE = re.compile(r"[.!?](?=\s)|\n")
_ALPHA = np.arange(592)
_TABLE = np.where((_ALPHA >= 97) & (_ALPHA <= 122), _ALPHA - 96, np.where((_ALPHA >= 48) & (_ALPHA <= 57), 27, np.where(_ALPHA < 128, MARK, 29 + _ALPHA % 3)))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def strings(text: str) -> list[str]:
    """The strings of a text, in lower case."""
    found, run = [], []
    words = text.lower().split()
    for w in words:
        if len(w) <= 2:
            run.append(w)
            continue
        if run:
            found.append(" ".join(run))
            run = []
        found.append(w)
    if run:
        found.append(" ".join(run))
    step = LONG // 2
    return [p for w in found for p in ([w] if len(w) <= LONG else [w[i : i + LONG] for i in range(0, len(w) - step, step)])]


def _keys(batch: list[str]) -> np.ndarray:
    """The subsequences of some strings between word ends in ascending order, one row each: a number and, in the low five bits, the number of its gaps."""
    size = np.array([len(w) for w in batch])[:, None]
    width = int(size.max()) + 2
    code = np.frombuffer("".join(batch).encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.arange(width)
    s = np.full((len(batch), width), _NONE, np.int32)
    s[(place > 0) & (place <= size)] = np.where(code < len(_TABLE), _TABLE[np.minimum(code, len(_TABLE) - 1)], 29 + code % 3)
    s[(place == 0) | (place == size + 1)] = 0
    s[s == MARK] = _NONE
    one, two, three = s * SYMBOLS**3, s * SYMBOLS**2, s * SYMBOLS
    key = np.concatenate([one[:, : width - b] + two[:, a : width - b + a] + (three[:, b:] + gap) for gap, (a, b) in enumerate(GAPS) if b < width], axis=1)
    key[key >= _NONE * SYMBOLS] = len(GAPS)  # holds a mark or ends behind the string: weighs nothing
    key.sort(axis=1)
    return key


def _sums(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of all keys; of equal subsequences of a row, the place of the first and the sum of the weights."""
    at, weight = key >> 5, _WEIGHTS[key & 31]
    new = np.ones(key.shape, bool)
    new[:, 1:] = at[:, 1:] != at[:, :-1]
    first = np.flatnonzero(new)
    return weight, first, np.add.reduceat(weight.ravel(), first)


def _norms(first: np.ndarray, total: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    norm = np.sqrt(np.add.reduceat(total * total, np.searchsorted(first, np.arange(shape[0]) * shape[1])))
    return np.where(norm > 0, norm, 1)


def subsequences(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of the subsequences of some strings, one row each; of equal ones the first holds all the weight."""
    key = _keys(batch)
    _, first, total = _sums(key)
    share = np.zeros(key.size)
    share[first] = total
    return key >> 5, share.reshape(key.shape) / _norms(first, total, key.shape)[:, None]


def values(found: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Value of every string."""
    out = np.zeros(len(found))
    order = sorted(range(len(found)), key=lambda i: len(found[i]))
    for start in range(0, len(found), BATCH):
        rows = order[start : start + BATCH]
        key = _keys([found[i] for i in rows])
        weight, first, total = _sums(key)
        out[rows] = np.einsum("ij,ij->i", weights[key >> 5], weight) / _norms(first, total, key.shape) + bias
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray | None  # per subsequence
    bias: float
    curve: tuple[float, ...]  # constant, highest value, log sum, log mean
    base: float


def hinge(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Squared-hinge support vector machine over rows with a weight in either class; the last column of ``x`` is one and its weight is free."""
    free = np.r_[np.ones(x.shape[1] - 1), 1e-6]

    def loss(v: np.ndarray, f: np.ndarray) -> float:
        return float((free * v * v).sum() + (toxic * np.maximum(0, 1 - f) ** 2 + clean * np.maximum(0, 1 + f) ** 2).sum())

    w, f = np.zeros(x.shape[1]), np.zeros(len(x))
    now = loss(w, f)
    for _ in range(100):
        up, down = np.where(f < 1, toxic, 0), np.where(f > -1, clean, 0)
        h, g = np.diag(free), np.zeros(len(w))
        for i in range(0, len(x), 2048):
            part = x[i : i + 2048].astype(np.float64)
            h += part.T @ (part * (up + down)[i : i + 2048, None])
            g += part.T @ (up - down)[i : i + 2048]
        step = np.linalg.solve(h, g) - w
        along = x @ step
        size = 1.0
        then = loss(w + step, f + along)
        while then > now and size > 1e-4:
            size /= 2
            then = loss(w + size * step, f + size * along)
        if now - then <= 1e-9 * now:
            break
        w, f, now = w + size * step, f + size * along, then
    return w


def machine(found: list[str], toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights per subsequence and bias from strings and their class weights (each class sums to one)."""
    by_hash = sorted(range(len(found)), key=lambda i: xxhash.xxh64_intdigest(found[i].encode("utf-8", "surrogatepass")))
    top = np.argsort(clean - toxic, kind="stable")[: LANDMARKS // 2].tolist()
    others = [i for i in by_hash if i not in set(top)][: LANDMARKS - len(top)]
    marks = np.zeros((len(top) + len(others), SYMBOLS**3), np.float32)
    for row, i in zip(marks, top + others):
        at, share = subsequences([found[i]])
        np.add.at(row, at[0], share[0])
    vals, vecs = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vecs[:, vals > 1e-5] / np.sqrt(vals[vals > 1e-5])
    table = np.ascontiguousarray(marks.T @ root.astype(np.float32))  # subsequence -> its part of the map
    x = np.ones((len(found), table.shape[1] + 1), np.float32)
    order = sorted(range(len(found)), key=lambda i: len(found[i]))
    for start in range(0, len(found), BATCH // 4):
        rows = order[start : start + BATCH // 4]
        at, share = subsequences([found[i] for i in rows])
        used = share.max(axis=0) > 0
        x[rows, :-1] = np.einsum("nt,ntm->nm", share[:, used].astype(np.float32), table[at[:, used]])
    w = hinge(x, toxic * MISFIT, clean * MISFIT)
    return (table @ w[:-1]).astype(np.float32), float(w[-1])


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights; the first column of ``x`` is one."""
    middle, scale = np.r_[0, x[:, 1:].mean(axis=0)], np.r_[1, np.maximum(x[:, 1:].std(axis=0), 1e-9)]
    z = (x - middle) / scale

    def loss(v: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ v))).sum() + ridge * v @ v / 2)

    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (weight * (y - p)) - ridge * w)
        size = 1.0
        while loss(w + size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w + size * step
    out = w / scale
    out[0] = w[0] - (w[1:] * middle[1:] / scale[1:]).sum()
    return out


def figures(docs: DataFrame, weights: np.ndarray, bias: float, keep: str) -> DataFrame:
    """``keep`` and the three figures of every document (last column: text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in slices(batches, "text", 4 << 20):
            held = [strings(t) for t in batch.column("text").to_pylist()]
            if len(known) > KNOWN:
                known = {}
            new = list(set().union(*held) - known.keys())
            known.update(zip(new, values(new, weights, bias).tolist()))
            out = np.zeros((len(held), 3))
            for row, found in zip(out, held):
                v = np.fromiter(map(known.__getitem__, found), float, len(found)) if found else np.array([bias])
                above = np.maximum(v - CLEAR, 0)
                row[:] = v.max(), np.log(0.02 + above.sum()), np.log(0.001 + above.mean())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c) for c in out.T)], names=[*batch.schema.names[:-1], "top", "sum", "mean"])

    return docs.mapInArrow(run, f"{keep}, top double, sum double, mean double")


def _sentences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        rows = {(y, s) for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()) for s in _SENTENCE.split(t) if s and not s.isspace()}
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((), ()), (pa.int32(), pa.string()))], names=["y", "sentence"])


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of different sentences, and how many sentences of either class hold them."""
    for batch in slices(batches, "sentence", 1 << 20):
        counts = Counter(), Counter()
        for y, s in zip(batch.column("y").to_pylist(), batch.column("sentence").to_pylist()):
            counts[y].update(set(strings(s)))
        found = list(counts[0].keys() | counts[1].keys())
        cols = [pa.array(found, pa.string()), *(pa.array([counts[y][u] for u in found], pa.int64()) for y in (1, 0))]
        yield pa.RecordBatch.from_arrays(cols, names=["unit", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Learn from the labels of documents outside the held-out fold."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.withColumn("part", crc % 5 == 4)
    counts = {(r.y, r.part): r["count"] for r in known.groupBy("y", "part").count().collect()}
    ones, all_labels = sum(n for (y, _), n in counts.items() if y), sum(counts.values())
    base = ones / all_labels if all_labels else 0.0
    if len({y for y, _ in counts}) < 2:
        return Model(None, 0.0, (), base)
    # a hash bound leaves about twice the rows wanted, so that the ranks below see a bounded number of rows
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    near = F.lit(False)
    for (y, part), n in counts.items():
        near |= (F.col("y") == y) & (F.col("part") == part) & (mark < int((1 << 32) * min(1.0, 2 * MAX_DOCS / n + 1e-9)))
    ranks = Window.partitionBy("y", "part").orderBy(mark, "doc_id")
    ranked = known.where(near).withColumn("n", F.row_number().over(ranks))
    chosen = staged(ranked.where(F.col("n") <= MAX_DOCS).drop("n"), "chosen")  # 4 * MAX_DOCS small rows by construction: with their size known, texts join them where they lie
    sample = staged(docs.select("doc_id", whole().alias("text")).join(chosen, "doc_id").select("y", "part", "text"), "sample")
    sentences = sample.where("NOT part").select("y", "text").mapInArrow(_sentences, "y int, sentence string").distinct()
    units = sentences.mapInArrow(_units, "unit string, toxic long, clean long")
    weigh = units.groupBy("unit").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean")))
    top = weigh.orderBy(F.desc(F.greatest(F.col("toxic") * all_labels / max(ones, 1), F.col("clean"))), "unit").limit(UNITS).toArrow()
    found, toxic, clean = top.column("unit").to_pylist(), *(top.column(c).to_numpy().astype(float) for c in ("toxic", "clean"))
    if not toxic.any() or not clean.any():
        return Model(None, 0.0, (), base)
    weights, bias = machine(found, toxic / toxic.sum(), clean / clean.sum())
    seen = figures(sample.where("part").select("y", "text"), weights, bias, "y int").toPandas()
    if seen["y"].nunique() < 2:
        return Model(None, 0.0, (), base)
    y = seen["y"].to_numpy()
    true = np.array([all_labels - ones, ones]) / np.bincount(y)
    x = np.c_[np.ones(len(y)), seen[["top", "sum", "mean"]].to_numpy()]
    return Model(weights, bias, tuple(curve(x, y, true[y] * len(y) / true[y].sum()).tolist()), base)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    texts = docs.select(F.col("doc_id").cast("long"), whole().alias("text"))
    if model.weights is None:
        found = texts.select("doc_id", F.lit(model.base).alias("score"))
    else:
        line = sum((F.col(c) * w for c, w in zip(("top", "sum", "mean"), model.curve[1:])), F.lit(model.curve[0]))
        line = F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0))
        found = figures(texts, model.weights, model.bias, "doc_id long").select("doc_id", (1 / (1 + F.exp(-line))).alias("score"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
