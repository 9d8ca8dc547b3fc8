"""Language identification by string kernels.

The kernel of two texts is the number of n-grams (2 to 4 bytes, blended) that occur in both, divided by the root of the product of
their numbers of n-grams. Landmarks span a Nyström map of that kernel, and one ridge regression per
language (one against the rest) is fitted in it. Presence of n-grams is kept in ``SLOTS`` hashed slots, so the kernel with
all landmarks is a matrix product of presence rows; folding landmarks and regression into one matrix scores a
batch of whole texts in one product.

Learning uses a bounded sample: of each language the ``PER_LANGUAGE`` rows of the learning fold with the smallest hash among those of up to ``LONG`` bytes; a language
whose texts are all longer is learned from its ``FEW`` shortest ones. Presence rows are kept sparse. Scoring reads every whole text
where it lies; only the matrix travels.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned; ties go to
the language that sorts first; repeated rows are scored alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import free_name, slices, whole

SLOTS = 1 << 15
GRAMS = (2, 3, 4)
PER_LANGUAGE = 400
LONG = 65_536
FEW = 4
MOST_LANGUAGES = 1000
FLOOR_GRAMS, FLOOR_BELOW = 150, 0.15
LANDMARKS = 240
RIDGE = 0.05
SHARPNESS = 6.0
ROWS = 128
UND = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_BLOCK = 1 << 20


def slots(text: str) -> np.ndarray:
    """Hashed slots of the n-grams of a lower-cased text, with repetitions."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    out = []
    for start in range(0, len(raw), _BLOCK):
        b = raw[start : start + _BLOCK + max(GRAMS) - 1].astype(np.uint32) + 1
        h = b * _FACTORS[0]
        for n in range(2, max(GRAMS) + 1):
            if len(b) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> 15)) + b[n - 1 :] * _FACTORS[n - 1]
            if n in GRAMS:
                out.append((h * _FACTORS[0] >> 17).astype(np.int64))
    return np.concatenate(out)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # slots x languages
    bias: np.ndarray
    floor: float = -np.inf  # best value below which a text of FLOOR_GRAMS different n-grams is in no learned language


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def presence(texts: list[str], out: np.ndarray) -> np.ndarray:
    """Rows of a presence matrix, written into ``out``."""
    rows = out[: len(texts)]
    rows[:] = 0
    for row, t in zip(rows, texts):
        row[slots(t)] = 1
    return rows


def _machine(rows: list[np.ndarray], y: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights per slot and bias of the regressions, from the slots present in every text."""
    size = np.sqrt([len(r) for r in rows])
    turn = np.argsort([(y[:i] == y[i]).sum() for i in range(len(y))], kind="stable")  # first of each language, second of each, ...
    chosen = turn[: max(LANDMARKS, languages)]
    marks = np.zeros((SLOTS, len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        marks[rows[i], j] = 1 / size[i]
    kernel = np.stack([marks[r].sum(axis=0, dtype=np.float64) / n for r, n in zip(rows, size)])
    values, vectors = np.linalg.eigh(kernel[chosen])
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    phi = kernel @ root
    target = np.where(y[:, None] == np.arange(languages), 1.0, -1.0)
    weight = 1.0 / np.bincount(y, minlength=languages)[y]
    weight /= weight.mean()
    mean_x, mean_y = np.average(phi, axis=0, weights=weight), np.average(target, axis=0, weights=weight)
    centred = phi - mean_x
    gram = (centred * weight[:, None]).T @ centred + RIDGE * np.eye(phi.shape[1])
    beta = np.linalg.solve(gram, (centred * weight[:, None]).T @ (target - mean_y))
    return (marks @ (root @ beta)).astype(np.float32), mean_y - mean_x @ beta


def learn(texts: list[str], langs: list[str]) -> Model:
    names = tuple(sorted(set(langs)))
    rows = [np.unique(slots(t)).astype(np.uint16) for t in texts]  # slots present: SLOTS is 2^15
    y = np.array([names.index(v) for v in langs])
    floor, other = -np.inf, np.arange(1, len(rows), 2)  # the floor is told by every second text, from a machine of the others
    if len(other):
        weights, bias = _machine(rows[::2], y[::2], len(names))
        own = np.stack([weights[rows[i]].sum(axis=0) / len(rows[i]) ** 0.5 + bias for i in other])
        right = own.max(axis=1)[(own.argmax(axis=1) == y[other]) & (np.array([len(rows[i]) for i in other]) >= FLOOR_GRAMS)]
        floor = float(right.min() - FLOOR_BELOW) if len(right) else floor
    return Model(names, *_machine(rows, y, len(names)), floor)


def fit(docs: DataFrame) -> Model | None:
    """Learn from text and non-null lang outside the held-out fold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    short = F.octet_length("text") <= LONG
    counts = rows.groupBy("lang").agg(F.count_if(short).alias("short"), F.count("*").alias("n")).orderBy("lang").collect()
    if not counts:
        return None
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{len(counts)} languages; the model is made for {MOST_LANGUAGES} at most")
    # a hash bound leaves about twice the rows wanted, so that the ranks below see a bounded number of rows
    mark = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32))
    near, far = F.lit(False), []
    for r in counts:
        if r.short:
            near |= (F.col("lang") == r.lang) & short & (mark < int((1 << 32) * min(1.0, 2 * PER_LANGUAGE / r.short + 1e-9)))
        else:
            far.append(r.lang)
    order = Window.partitionBy("lang").orderBy(mark, "doc_id")
    sample = rows.where(near).withColumn("k", F.row_number().over(order)).where(F.col("k") <= PER_LANGUAGE).select("text", "lang", mark.alias("mark"), "doc_id")
    found = sample.orderBy("mark", "doc_id").select("text", "lang").collect()
    for lang in far:  # whole texts, one language at a time
        found += rows.where(F.col("lang") == lang).orderBy(F.octet_length("text"), mark, "doc_id").select("text", "lang").limit(FEW).collect()
    return learn([r.text for r in found], [r.lang for r in found])


def tagged(docs: DataFrame, model: Model | None, lang: str = "lang_pred", score: str = "score", told: str | None = None) -> DataFrame:
    """All columns of ``docs`` with the predicted language, its score and, with ``told``, whether the text is in a learned language at all. The names have to be free."""
    lettered = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        found = docs.withColumns({lang: F.lit(UND), score: F.lit(0.0)})
        return found.withColumn(told, lettered) if told else found
    read = free_name(docs, "read")
    rows = docs.select("*", F.when(lettered, F.col("text").cast("string")).alias(read))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((ROWS, SLOTS), np.float32)
        for piece in slices(batches, read):
            for start in range(0, piece.num_rows, ROWS):
                batch = piece.slice(start, ROWS)
                texts = batch.column(read).to_pylist()
                x = presence([t or "" for t in texts], held)
                grams = x.sum(axis=1)
                f = (x @ model.weights) / np.sqrt(grams)[:, None] + model.bias
                p = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                some = np.array([t is not None for t in texts], bool)
                known = some & ((f.max(axis=1) >= model.floor) | (grams < FLOOR_GRAMS))
                names = [model.languages[b] if s else UND for s, b in zip(some, best)]
                top = np.where(some, p[np.arange(len(p)), best], 0.0)
                cols = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(top, pa.float64()), *([pa.array(known)] if told else [])]
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], lang, score, *([told] if told else [])])

    kinds = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes)
    return rows.mapInArrow(run, f"{kinds}, `{lang}` string, `{score}` double" + (f", `{told}` boolean" if told else ""))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    found = tagged(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows in a language that could be told, with all their columns.

    A text without a letter goes, and one of ``FLOOR_GRAMS`` different n-grams or more whose best value lies ``FLOOR_BELOW`` under the lowest of the learning texts
    that a machine of the other half told rightly. Where nothing could be learned, texts with a letter stay.
    """
    lang, score, told = (free_name(docs, n) for n in ("lang_pred", "score", "told"))
    return tagged(docs, model, lang, score, told).where(F.col(told)).select(*[F.col(f"`{c}`") for c in docs.columns])
