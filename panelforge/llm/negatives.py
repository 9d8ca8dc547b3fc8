"""Hard-negative mining by angular triangle filtering.

Every row keeps its norm and its angles to reference directions (by their cosines). For two rows at angles s and t to one direction the angle between them
lies between |s - t| and s + t, so its cosine lies within cos s cos t -+ sin s sin t. For several orthogonal directions the products of the cosines add up and
the sines are those of the angles to the span of all, which narrows the interval with every direction. The product of the norms turns it into an interval for the
integer score, widened for rounding. Only pairs whose interval overlaps the window of scores that is asked for get an integer inner product:

1. Positives: the window is open above and starts at the anchor's k-th best score known so far; rows of the anchor's label are taken in falling order of
   their upper bound, so the window narrows fast.
2. Negatives: each positive asks for the scores from ``low`` to ``high`` percent of its own. A row of another label is scored if its interval overlaps one of the
   anchor's windows. Intervals of ``GROUP`` anchors with a block come from one matrix product over the directions.

The directions are the principal ones of a bounded sample of rows; they decide how much the filter saves, not what is found. Vectors without a preferred
direction (64 independent components) leave the filter little: 41 % of the negatives and 11 % of the positives had to be scored.

Anchors meet candidates in blocks of fixed size, positives within blocks of a label; what leaves a task is k rows per anchor or positive,
and the best of all blocks are chosen per anchor or positive.

Defined results: rows with a null label, a null vector, or a null or non-finite component, take no part, nor do rows without id; repeated rows of an
id are rows of their own (only the anchor's own row is not its partner); missing trailing components count as zero; vectors of norm zero have score 0 with
every row; scores beyond 64 bits saturate; ties go to the smaller id; fewer rows than asked for give fewer; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.staging import staged
from panelforge.llm.common import ROW, with_row

SAMPLE = 1000  # rows that give the directions
DIRECTIONS = 7 / 8  # of the dimensions
GROUP = 32
ANCHORS, CANDIDATES = 1024, 16_384
STEP = 256  # candidates scored at a time while the window of positives narrows
SLACK = 1e-6  # relative widening of a bound for rounding
_LIMIT = np.iinfo(np.int64).max - 1


def quantised(rows: DataFrame, label: Column, vector: str, scale: float) -> DataFrame:
    """Row mark, vec_id, label and integer components of the usable rows."""
    x = F.col(vector).cast("array<double>")
    sound = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & label.isNotNull() & F.col("vec_id").isNotNull()
    comp = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    return rows.where(F.coalesce(sound, F.lit(False))).select(ROW, "vec_id", label.cast("long").alias("label"), comp.alias("comp"))


def references(rows: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Orthogonal unit directions as columns, the principal ones of ``sample`` rows first."""
    found = rows.orderBy(F.xxhash64(ROW), ROW).limit(sample).select("comp").toPandas()["comp"]
    width = int(found.map(len).max()) if len(found) else 0
    if not width:
        return np.zeros((0, 0))
    x = matrix(found, width).astype(np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1), 1)[:, None]
    return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, : max(1, int(width * DIRECTIONS))]


def matrix(comps: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(comps), width), np.int64)
    for to, v in zip(out, comps):
        to[: len(v)] = v
    return out


class Rows:
    """Integer rows with their norms and the cosines of their angles to the directions."""

    def __init__(self, frame: pd.DataFrame, refs: np.ndarray) -> None:
        self.mark, self.id, self.label = (frame[c].to_numpy() for c in (ROW, "vec_id", "label"))
        width = max(frame["comp"].map(len).max(), len(refs))
        self.x = matrix(frame["comp"], width)
        x = self.float = self.x.astype(np.float64)
        self.norm = np.linalg.norm(x, axis=1)
        self.cosine = (x[:, : len(refs)] @ refs) / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.sine = np.sqrt(np.maximum(0, 1 - (self.cosine**2).sum(axis=1)))
        self.most = int(np.abs(self.x.astype(object)).max()) if self.x.size else 0


def bounds(some: slice, a: Rows, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the integer scores of some anchors (rows) with all rows (columns)."""
    product = np.outer(a.norm[some], rows.norm)
    middle, spread = a.cosine[some] @ rows.cosine.T, np.outer(a.sine[some], rows.sine)
    wide = product * SLACK + 1
    return np.floor(product * np.maximum(middle - spread, -1) - wide), np.ceil(product * np.minimum(middle + spread, 1) + wide)


def united(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The windows that are not empty, those that overlap in one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(w for w in windows if w[0] <= w[1]):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def overlapping(least: np.ndarray, most: np.ndarray, windows: list[tuple[int, int]]) -> np.ndarray:
    """Which of the intervals overlap a window."""
    inside = np.zeros(len(least), bool)
    for lo, hi in united(windows):
        inside |= (most >= lo) & (least <= hi)
    return inside


def exact(rows: Rows, at: np.ndarray, a: Rows, anchor: int) -> np.ndarray:
    """Integer inner products of some rows with an anchor; in floating point where every partial sum is an integer below 2^53."""
    if not len(at):
        return np.zeros(0, np.int64)
    n = min(rows.x.shape[1], a.x.shape[1])
    limit = rows.most * a.most * max(n, 1)
    if limit < 1 << 53:
        return (rows.float[at, :n] @ a.float[anchor, :n]).astype(np.int64)
    x, y = rows.x[at, :n], a.x[anchor, :n]
    if limit < 1 << 62:
        return x @ y
    return np.clip((x.astype(object) * y.astype(object)).sum(axis=1), -_LIMIT, _LIMIT).astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


POSITIVES = "anchor_row long, anchor_id long, positive_id long, positive_row long, positive_score long"


def _positives(refs: np.ndarray, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(anchors) and len(candidates):
            a, c = Rows(anchors, refs), Rows(candidates, refs)
            for i in range(len(a.id)):
                if i % GROUP == 0:
                    highs = bounds(slice(i, i + GROUP), a, c)[1]
                high = highs[i % GROUP]
                order = np.argsort(-high, kind="stable")
                order = order[c.mark[order] != a.mark[i]]
                score, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for start in range(0, len(order), STEP):
                    now = order[start : start + STEP]
                    if len(score) == k:
                        now = now[high[now] >= score.min()]
                        if not len(now):
                            break
                    score, at = np.r_[score, exact(c, now, a, i)], np.r_[at, now]
                    best = _best(score, c.id[at], k)
                    score, at = score[best], at[best]
                found.append(pd.DataFrame({"anchor_row": a.mark[i], "anchor_id": a.id[i], "positive_id": c.id[at], "positive_row": c.mark[at], "positive_score": score}))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({n.split()[0]: pd.Series(dtype="int64") for n in POSITIVES.split(", ")})

    return run


def window_percent(score: int, low: int, high: int) -> tuple[int, int]:
    """Smallest and largest integer n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


NEGATIVES = "anchor_row long, positive_row long, negative_id long, negative_row long, negative_score long"


def _negatives(refs: np.ndarray, k: int, low: int, high: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(anchors) and len(candidates):
            a, c = Rows(anchors, refs), Rows(candidates, refs)
            for i, wanted in enumerate(anchors["wanted"]):
                windows = [(w["positive_row"], *window_percent(int(w["positive_score"]), low, high)) for w in wanted]
                if i % GROUP == 0:
                    lows, highs = bounds(slice(i, i + GROUP), a, c)
                at = np.flatnonzero(overlapping(lows[i % GROUP], highs[i % GROUP], [w[1:] for w in windows]) & (c.label != a.label[i]))
                score = exact(c, at, a, i)
                for row, lo, hi in windows:
                    fits = np.flatnonzero((score >= lo) & (score <= hi))
                    best = fits[_best(score[fits], c.id[at[fits]], k)]
                    found.append(pd.DataFrame({"anchor_row": a.mark[i], "positive_row": row, "negative_id": c.id[at[best]], "negative_row": c.mark[at[best]], "negative_score": score[best]}))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({n.split()[0]: pd.Series(dtype="int64") for n in NEGATIVES.split(", ")})

    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best rows of the same
    label, the best rows of other labels with a score from ``low`` to ``high`` percent of the positive's."""
    rows = staged(quantised(with_row(vectors.select("vec_id", vector, label.alias("label"))), F.col("label"), vector, scale), "rows")
    refs = references(rows)
    anchors = staged(rows.where(is_anchor), "anchors")
    n, na = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    block = lambda blocks: F.pmod(F.xxhash64(ROW), blocks).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))

    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / CANDIDATES).cast("int").alias("cs"), F.greatest(F.ceil(F.count_if(is_anchor) / ANCHORS), F.lit(1)).cast("int").alias("qs"))
    sizes = staged(sizes, "sizes")
    mine = anchors.join(sizes, "label").select(ROW, "vec_id", "label", "comp", block(F.col("qs")).alias("qb"), every(F.col("cs")).alias("cb"))
    theirs = rows.join(sizes, "label").select(ROW, "vec_id", "label", "comp", block(F.col("cs")).alias("cb"), every(F.col("qs")).alias("qb"))
    keys = ["label", "qb", "cb"]
    near = mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(_positives(refs, positives), POSITIVES)
    order = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    near = staged(near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives).drop("k"), "positives")

    wanted = near.groupBy(F.col("anchor_row").alias(ROW)).agg(F.collect_list(F.struct("positive_row", "positive_score")).alias("wanted"))  # ``positives`` at most
    asking = staged(anchors.join(wanted, ROW), "asking")
    q_blocks, c_blocks = F.lit(-(-max(na, 1) // ANCHORS)), F.lit(-(-max(n, 1) // CANDIDATES))
    mine = asking.select(ROW, "vec_id", "label", "comp", "wanted", block(q_blocks).alias("qb"), every(c_blocks).alias("cb"))
    theirs = rows.select(ROW, "vec_id", "label", "comp", block(c_blocks).alias("cb"), every(q_blocks).alias("qb"))
    far = mine.groupBy("qb", "cb").cogroup(theirs.groupBy("qb", "cb")).applyInPandas(_negatives(refs, negatives, low, high), NEGATIVES)
    order = Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return far.join(near, ["anchor_row", "positive_row"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
