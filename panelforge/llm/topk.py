"""Exact top-k search by exhaustive term-at-a-time accumulation.

A dimension is a term; its postings are the candidates of a block with a non-zero weight there. Query rows are sparse lists of
(term, weight): each term scatters its weighted postings into a dense array of scores, one per candidate. The k best of
a block are selected by partition, and the winners of all blocks are merged per query.

The query set meets all candidates in blocks: queries are dealt to blocks of ``QUERIES`` and candidates to blocks of
``CANDIDATES``, and each task works on one pair of blocks of fixed size. What leaves a task is k rows per query.

Defined results: vectors that are null or hold a null or non-finite component, and rows without id, take no part;
repeated rows of an id are rows of their own (a query row leaves out itself only, and each gives its own answer); missing trailing components count as zero; scores
beyond 64 bits saturate; ties go to the smaller id; fewer than k candidates give fewer rows.
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

QUERIES = 2048
CANDIDATES = 16_384
FOUND = "query_row long, query_id long, vec_row long, vec_id long, score long"
ROWS = 64  # query rows whose dense arrays are held at once
_LOW = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Row mark, vec_id and integer components of the rows with a usable vector."""
    x = F.col(vector).cast("array<double>")
    sound = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    comp = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.select(ROW, "vec_id", comp.alias("comp"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def accumulate(queries: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores of all candidates for some query rows, term after term."""
    scores = np.zeros((len(queries), n), queries.dtype)
    for term, (ids, weights) in enumerate(postings):
        rows = np.flatnonzero(queries[:, term])
        if len(rows) and len(ids) == n:
            for r in rows:
                scores[r] += queries[r, term] * weights
        elif len(rows) and len(ids):
            for r in rows:
                scores[r, ids] += queries[r, term] * weights
    return scores


def best_of_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, q_marks: np.ndarray, c_marks: np.ndarray) -> pd.DataFrame:
    """The k best candidates of the block for every query; candidates are sorted by id. Marks tell rows apart."""
    largest = [int(np.abs(m.astype(object)).max()) if m.size else 0 for m in (q, c)]
    if largest[0] * largest[1] * max(q.shape[1], 1) >= 1 << 62:
        q, c = q.astype(object), c.astype(object)  # exact integers
    postings = [(ids := np.flatnonzero(c[:, t]), c[ids, t]) for t in range(c.shape[1])]
    found, by_mark = [], np.argsort(c_marks)
    sorted_marks = c_marks[by_mark]
    for start in range(0, len(q), ROWS):
        scores = accumulate(q[start : start + ROWS], postings, len(c))
        if scores.dtype == object:
            scores = np.clip(scores, _LOW + 1, -(_LOW + 1)).astype(np.int64)
        marks = q_marks[start : start + ROWS]
        at = np.minimum(np.searchsorted(sorted_marks, marks), len(c_ids) - 1)
        own = sorted_marks[at] == marks
        scores[np.flatnonzero(own), by_mark[at[own]]] = _LOW
        least = np.partition(scores, -k, axis=1)[:, -k] if len(c) > k else np.full(len(scores), _LOW)
        for r, row in enumerate(scores):
            ids = np.flatnonzero(row >= least[r])
            ids = ids[np.argsort(-row[ids], kind="stable")][:k]
            ids = ids[row[ids] > _LOW]
            found.append(pd.DataFrame({"query_row": q_marks[start + r], "query_id": q_ids[start + r], "vec_row": c_marks[ids], "vec_id": c_ids[ids], "score": row[ids]}))
    return pd.concat(found, ignore_index=True)


def _search(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or candidates.empty:
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in FOUND.split(", ")})
        candidates = candidates.sort_values("vec_id")
        width = max(max(map(len, queries["comp"])), max(map(len, candidates["comp"])))
        return best_of_block(queries["vec_id"].to_numpy(), _matrix(queries["comp"], width), candidates["vec_id"].to_numpy(), _matrix(candidates["comp"], width), k, queries[ROW].to_numpy(), candidates[ROW].to_numpy())

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for every query row."""
    rows = staged(quantised(with_row(vectors), vector), "vectors")
    n, nq = rows.agg(F.count("*"), F.count_if(is_query)).first()
    q_blocks, c_blocks = -(-max(nq, 1) // QUERIES), -(-max(n, 1) // CANDIDATES)
    block = lambda blocks: F.pmod(F.xxhash64(ROW), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = staged(rows.where(is_query), "queries")
    queries = asked.select(ROW, "vec_id", "comp", block(q_blocks).alias("qb"), every(c_blocks).alias("cb"))
    candidates = rows.select(ROW, "vec_id", "comp", block(c_blocks).alias("cb"), every(q_blocks).alias("qb"))
    found = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInPandas(_search(k), FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
