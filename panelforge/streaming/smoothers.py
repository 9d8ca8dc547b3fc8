"""Recursive indicators resumed from stored state.

Exponential and Wilder smoothing reach back to the first row, so no bounded history gives their next value; their state does: a few numbers per entity. Every
computed row keeps the state behind it. A daily run joins the new rows with the last state of their entity and reads no history; a late row (older than what is stored
for its entity) starts from the state before it, and the rows of that entity from there on are computed again.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.windows import Axis

SMOOTH = 14
AVERAGES = {"e9": 9, "e12": 12, "e21": 21, "e26": 26}
OUTPUT = ("ema_9", "ema_21", "macd", "macd_signal", "macd_hist", "rsi_14", "atr_14", "adx_14")
INPUT = ("price", "hi", "lo", "cl")


@dataclass
class State:
    """What the smoothers of one entity remember: the row before, exponential means, and per Wilder mean its count and its sum (before the seed) or value."""

    price: float | None = None
    hi: float | None = None
    lo: float | None = None
    cl: float | None = None
    e9: float | None = None
    e12: float | None = None
    e21: float | None = None
    e26: float | None = None
    signal: float | None = None
    up_n: int = 0
    up: float = 0.0
    down_n: int = 0
    down: float = 0.0
    reach_n: int = 0
    reach: float = 0.0
    later_n: int = 0
    later: float = 0.0
    plus_n: int = 0
    plus: float = 0.0
    minus_n: int = 0
    minus: float = 0.0
    index_n: int = 0
    index: float = 0.0

    def mean(self, name: str, span: int, x: float) -> float:
        """Exponential mean, seeded by its first value."""
        before, share = getattr(self, name), 2.0 / (span + 1)
        setattr(self, name, x if before is None else before * (1 - share) + x * share)
        return getattr(self, name)

    def wilder(self, name: str, x: float | None) -> float | None:
        """Wilder mean, seeded by the mean of its first values; missing values leave it as it is and give none."""
        if x is None:
            return None
        n, value = getattr(self, f"{name}_n") + 1, getattr(self, name)
        value = value + x if n < SMOOTH else (value + x) / SMOOTH if n == SMOOTH else value * ((SMOOTH - 1) / SMOOTH) + x / SMOOTH
        setattr(self, f"{name}_n", n)
        setattr(self, name, value)
        return value if n >= SMOOTH else None

    def step(self, price: float, hi: float, lo: float, cl: float) -> tuple:
        """Take one row in and give its indicators."""
        means = {name: self.mean(name, span, price) for name, span in AVERAGES.items()}
        line = means["e12"] - means["e26"]
        signal = self.mean("signal", 9, line)
        first = self.price is None
        reach = hi - lo if first else max(hi - lo, abs(hi - self.cl), abs(lo - self.cl))
        rise, fall = (None, None) if first else (hi - self.hi, self.lo - lo)
        up = self.wilder("up", None if first else max(price - self.price, 0.0))
        down = self.wilder("down", None if first else max(self.price - price, 0.0))
        atr, base = self.wilder("reach", reach), self.wilder("later", None if first else reach)
        plus = self.wilder("plus", None if first else rise if rise > fall and rise > 0 else 0.0)
        minus = self.wilder("minus", None if first else fall if fall > rise and fall > 0 else 0.0)
        adx = None
        if base:
            a, b = plus / base * 100.0, minus / base * 100.0
            adx = self.wilder("index", abs(a - b) / (a + b) * 100.0 if a + b else None)
        rsi = None if down is None else 100.0 if down == 0 else 100.0 - 100.0 / (1.0 + up / down)
        self.price, self.hi, self.lo, self.cl = price, hi, lo, cl
        return means["e9"], means["e21"], line, signal, line - signal, rsi, atr, adx


STATE = tuple(f.name for f in fields(State))
_COUNTS = tuple(n for n in STATE if n.endswith("_n"))
STATE_TYPE = "struct<" + ", ".join(f"{n}:{'int' if n in _COUNTS else 'double'}" for n in STATE) + ">"


def advanced(rows: DataFrame, before: DataFrame, axis: Axis) -> DataFrame:
    """Indicators and the state after every row; ``rows`` has the axis columns and ``INPUT``, ``before`` the entity and ``state`` (or no row for a new one).

    A row with a missing input gives no indicators and leaves the state as it is.
    """
    key, on = axis.by[0], axis.on
    kinds = dict(rows.dtypes)
    out = f"`{key}` {kinds[key]}, `{on}` {kinds[on]}, " + ", ".join(f"{c} double" for c in OUTPUT) + f", state {STATE_TYPE}"

    def run(new: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        stored = held["state"].iloc[0] if len(held) else None
        known = {n: stored[n] for n in STATE if stored[n] is not None and stored[n] == stored[n]} if stored is not None else {}
        state, found = State(**known), []
        new = new.sort_values(on)
        for row in zip(*(new[c] for c in (key, on, *INPUT))):
            usable = all(x is not None and x == x for x in row[2:])
            values = state.step(*map(float, row[2:])) if usable else (None,) * len(OUTPUT)
            found.append((*row[:2], *values, {n: getattr(state, n) for n in STATE}))
        return pd.DataFrame(found, columns=[key, on, *OUTPUT, "state"])

    held = before.select(F.col(key).alias("_of"), "state")  # names of its own, where both sides come from one table
    return rows.groupBy(key).cogroup(held.groupBy("_of")).applyInPandas(run, out)


def latest(stored: DataFrame, axis: Axis) -> DataFrame:
    """The last date and state of every entity: the table a daily run reads instead of the history."""
    return stored.groupBy(*axis.by).agg(F.max(axis.on).alias("_last"), F.max_by("state", axis.on).alias("state"))


def update(rows: DataFrame, arrived: DataFrame, stored: DataFrame, last: DataFrame, axis: Axis) -> DataFrame:
    """The rows of ``stored`` that have to be written anew or added, after ``arrived`` keys (axis columns) came in.

    ``rows`` holds all input rows, those that arrived included; ``last`` is ``latest(stored)`` as kept from the run before. Of ``rows`` only those from the first arrived
    date on are read. ``stored`` itself is read for entities with late rows only.
    """
    key, on = axis.by[0], axis.on
    begin = arrived.groupBy(key).agg(F.min(on).alias("_begin"))
    marked = begin.join(last, key, "left")
    late = marked.where(F.col("_begin") <= F.col("_last")).select(key, "_begin")
    before = marked.where(F.col("_begin") > F.col("_last")).select(key, "state")
    if not late.isEmpty():
        earlier = stored.select(key, on, "state").join(late, key).where(F.col(on) < F.col("_begin"))
        before = before.union(earlier.groupBy(key).agg(F.max_by("state", on).alias("state")))
    first = arrived.agg(F.min(on)).scalar()
    todo = rows.where(F.col(on) >= first).join(begin, key).where(F.col(on) >= F.col("_begin")).drop("_begin")
    return advanced(todo, before, axis)


def merged(stored: DataFrame, changed: DataFrame, axis: Axis) -> DataFrame:
    """``stored`` with the changed rows in place of those of the same key."""
    keys = [*axis.by, axis.on]
    return stored.join(changed.select(*keys), keys, "left_anti").unionByName(changed)
