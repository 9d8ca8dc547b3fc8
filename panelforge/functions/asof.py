"""As-of joins: match each left row with the nearest right row in time.

Plan: union of both sides tagged by side, one shuffle by key, and a running ``last`` over the key's
time line. Spark's own range-style plans for this are nested loops. Left keys are reduced to distinct
(key, time) pairs first, so a key shared by a third of all rows still has a time line bounded by the calendar;
the matches then return to the full left side through an equi-join that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    take: Sequence[str],
    direction: str = "backward",
    strict: bool = False,
    left_unique: bool = False,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Left columns plus ``take`` (and ``right_on`` if listed) from the matched right row, NULL without a match.

    ``strict`` excludes equal times. ``left_unique=True`` states that (by, left_on) is unique on the left, which
    saves the distinct and the join back. (by, right_on) must be unique on the right. ``probe`` may name a cheaper
    frame holding all (by, left_on) pairs of the left, when the left itself is costly to compute twice.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be 'backward' or 'forward'")
    keys = list(by)
    own = [c for c in left.columns if c not in keys] if left_unique else [left_on]
    if left_unique:
        probe = left
    else:
        probe = (left if probe is None else probe).select(*keys, left_on).distinct()
    right_side = right.where(F.col(right_on).isNotNull()).select(
        *keys,
        F.col(right_on).alias("_t"),
        F.lit(0).alias("_side"),
        F.struct(*[F.col(c).alias(c) for c in take]).alias("_r"),
    )
    left_side = probe.select(
        *keys, F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.struct(*own).alias("_l")
    )
    both = left_side.unionByName(right_side, allowMissingColumns=True)
    # right rows come before equal left rows unless equal times do not match
    tie = F.col("_side").desc() if strict else F.col("_side").asc()
    # always looking back, along descending times for a forward match: a frame that looks ahead is re-read at every row
    time = F.col("_t").asc() if direction == "backward" else F.col("_t").desc()
    w = Window.partitionBy(*keys).orderBy(time, tie)
    hit = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    matched = both.withColumn("_m", hit).where("_side = 1")
    matched = matched.select(
        *keys, *[F.col("_l")[c].alias(c) for c in own], *[F.col("_m")[c].alias(c) for c in take]
    )
    return matched if left_unique else left.join(matched, [*keys, left_on], "left")
