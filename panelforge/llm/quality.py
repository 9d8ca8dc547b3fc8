"""Compression classifier: zstandard dictionaries of good and of bad labelled text.

A text is compressed with either dictionary; the difference of the two sizes, divided by the text's length, tells
which class it resembles, and the smaller size per byte how far it repeats itself. A logistic curve over both,
fitted on labelled texts that the dictionaries have not seen and weighted by the class counts of all labels, gives the score.

Learning uses a bounded sample: of each class, and for dictionaries and curve apart, the ``MAX_TEXTS`` labelled ids with the
smallest hash, of which texts up to ``MAX_BYTES`` are taken. Scoring reads every whole text where it lies; only the two
dictionaries and three weights travel.

Defined results: null text is empty text; an empty text gets the share of good labels; without labels of both classes every
score is the share of good labels (0.5 without labels); labels that are null are not learned; a document with
several labels is learned once for each; repeated rows are scored alike; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import slices, whole

MAX_TEXTS = 1500
MAX_BYTES = 32_768
DICTIONARY = 65_536
SAMPLE = 1000
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float] | None
    base: float


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    samples = [t[i : i + SAMPLE] for t in texts for i in range(0, len(t), SAMPLE)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class Sizes:
    def __init__(self, model: Model) -> None:
        self.coders = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]

    def features(self, text: bytes) -> tuple[float, float, float]:
        good, bad = (len(c.compress(text)) for c in self.coders)
        return 1.0, 10 * (bad - good) / len(text), math.log(min(good, bad) / len(text) + 0.01)


def _feature_rows(df: DataFrame, model: Model, keep: str) -> DataFrame:
    """``keep`` and the features of non-empty texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model)
        for batch in slices(batches, "text"):
            x = [sizes.features(t.encode()) if t else (None, None, None) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.float64()) for c in zip(*x))], names=[*batch.schema.names[:-1], "one", "difference", "ratio"])

    return df.mapInArrow(run, f"{keep}, one double, difference double, ratio double")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w), -5, 5)
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learn from the labels of documents outside the held-out fold."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    counts = dict(known.groupBy("y").count().collect())
    base = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len(counts) < 2:
        return Model(b"", b"", None, base)
    part = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 4).alias("part")
    order = F.xxhash64("doc_id")
    first = Window.partitionBy("y", "part").orderBy(order, "doc_id")
    chosen = known.select("doc_id", "y", part).withColumn("n", F.row_number().over(first)).where(F.col("n") <= MAX_TEXTS).drop("n")  # 4 * MAX_TEXTS rows at most
    text = docs.select(F.col("doc_id"), whole().alias("text")).where(F.octet_length("text").between(1, MAX_BYTES))
    sample = text.join(F.broadcast(chosen), "doc_id")
    rows = sample.where("not part").orderBy(order, "y", "text").limit(2 * MAX_TEXTS).select("y", "text").collect()
    draft = Model(*(dictionary([r.text.encode() for r in rows if r.y == y]) for y in (1, 0)), None, base)
    seen = _feature_rows(sample.where("part").orderBy(order, "y", "text").limit(2 * MAX_TEXTS).select("y", "text"), draft, "y int").collect()
    y = np.array([r.y for r in seen])
    if len(set(y.tolist())) < 2:
        return Model(draft.good, draft.bad, None, base)
    share = np.array([counts[v] / (y == v).sum() for v in y])
    x = np.array([(r.one, r.difference, r.ratio) for r in seen])
    return Model(draft.good, draft.bad, tuple(logistic(x, y, share * len(y) / share.sum()).tolist()), base)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    texts = docs.select(F.col("doc_id").cast("long"), whole().alias("text"))
    x = _feature_rows(texts, model, "doc_id long")
    if model.weights:
        line = sum((F.col(c) * w for c, w in zip(("one", "difference", "ratio"), model.weights)), F.lit(0.0))
        value = F.when(F.col("one").isNull(), model.base).otherwise(1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0)))))
    else:
        value = F.lit(model.base)
    return x.select("doc_id", held_out().alias("held_out"), value.cast("double").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
