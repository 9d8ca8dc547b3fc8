"""Hard negatives against all inner products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelforge.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, comp string, qb int"


def plain(rows, positives, count, low, high, step):
    used = []
    for vec_id, v, label, *_ in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))

    def best(found, k):
        return sorted(found, key=lambda f: (-f[1], f[0]))[:k]

    out = []
    for i, (anchor, label, a) in enumerate(used):
        if anchor % step:
            continue
        scored = [(j, c, l, sum(x * y for x, y in zip(a, v))) for j, (c, l, v) in enumerate(used) if j != i]
        for c, score in best([(c, s) for _, c, l, s in scored if l == label], positives):
            near = best([(n, s) for _, n, l, s in scored if l != label and low * score <= 100 * s <= high * score], count)
            out += [(anchor, c, k, n, score, s) for k, (n, s) in enumerate(near, 1)]
    return sorted(out)


def made(seed, n, width):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(n):
        v = [rng.gauss(x, 0.4) for x in rng.choice(centre)]
        rows.append((i, v, rng.randrange(4), "x", 1))
    rows += [(i, [float(round(x)) for x in rng.choice(centre)], rng.randrange(3), "x", 1) for i in range(n, n + 60)]  # ties
    rows += [rows[0], rows[0], rows[5], (None, centre[0], 1, "x", 1), (3000, None, 1, "x", 1), (3010, [1.0, None], 1, "x", 1), (3020, [float("nan")] * width, 1, "x", 1), (3030, [float("inf")], 1, "x", 1)]
    rows += [(3040, centre[0], None, "x", 1), (3050, [], 1, "x", 1), (3060, [0.0] * width, 1, "x", 1), (3070, centre[0][:2], 2, "x", 1), (3080, centre[1] + [2.0, 3.0], 2, "x", 1), (3090, [1e6] * width, 1, "x", 1), (4000, [-3e6] * width, 1, "x", 1)]
    return rows


@pytest.mark.parametrize("width,blocks", [(12, (1024, 16384)), (3, (7, 50)), (1, (1024, 16384))])
def test_against_all_products(spark, monkeypatch, width, blocks):
    monkeypatch.setattr(negatives, "ANCHORS", blocks[0])
    monkeypatch.setattr(negatives, "CANDIDATES", blocks[1])
    monkeypatch.setattr(negatives, "STEP", 8)
    rows = made(width, 300, width)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 10 == 0, label)
    want = plain(rows, 5, 3, 50, 95, 10)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_filter_saves_scores_and_keeps_bounds(spark):
    import numpy as np
    import pandas as pd

    rows = [r for r in made(1, 400, 16) if r[0] is not None and r[0] < 400]
    frame = pd.DataFrame({negatives.ROW: range(len(rows)), "vec_id": [r[0] for r in rows], "label": [r[2] for r in rows], "comp": [[math.floor(256 * x) for x in r[1]] for r in rows]})
    found = negatives.Rows(frame, negatives.references(spark.createDataFrame(frame.astype({"comp": object}))))
    scored = 0
    lows, highs = negatives.bounds(slice(0, None), found, found)
    for i in range(0, 400, 20):
        score = found.x @ found.x[i]
        assert (lows[i] <= score).all() and (score <= highs[i]).all() and (negatives.exact(found, np.arange(len(rows)), found, i) == score).all()
        top = int(np.sort(score)[-6])
        scored += negatives.overlapping(lows[i], highs[i], [negatives.window_percent(top, 50, 95)]).sum()
    assert scored < 0.6 * 20 * len(rows)


def test_empty(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0, F.col("label")).count() == 0
