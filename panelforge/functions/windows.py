"""Ordered windows over a panel.

A panel holds at most one row per (entity, date), so a window partitioned by entity is bounded by the
length of the calendar (some ten thousand rows for forty years of daily data), however skewed the raw
facts behind it are: raw facts are always pre-aggregated to (entity, date) first. The same holds for
market series, which have one row per date.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelforge.functions.numeric import col, safe_ratio

UNBOUNDED_BACK = Window.unboundedPreceding


@dataclass(frozen=True)
class Axis:
    """Time axis of a panel: entity columns plus the date column that orders them."""

    by: tuple[str, ...] = ("tk",)
    on: str = "d"

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(self.on)

    def rows(self, lo: int, hi: int) -> WindowSpec:
        return self.ordered().rowsBetween(lo, hi)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.by)

    def shift(self, c: Column | str, n: int = 1) -> Column:
        """Value ``n`` rows earlier (negative ``n``: later)."""
        return F.lag(col(c), n).over(self.ordered()) if n >= 0 else F.lead(col(c), -n).over(self.ordered())

    def diff(self, c: Column | str, n: int = 1) -> Column:
        return col(c) - self.shift(c, n)

    def pct_change(self, c: Column | str, n: int = 1) -> Column:
        """Relative change over ``n`` rows; gaps are not filled."""
        return safe_ratio(c, self.shift(c, n)) - 1

    def roll(
        self, fn: Callable[[Column], Column], c: Column | str, n: int, min_count: int | None = None
    ) -> Column:
        """``fn`` over the last ``n`` rows once at least ``min_count`` of them are non-null."""
        w = self.rows(-(n - 1), 0)
        need = n if min_count is None else min_count
        return F.when(F.count(col(c)).over(w) >= need, fn(col(c)).over(w))

    def running(self, fn: Callable[[Column], Column], c: Column | str) -> Column:
        return fn(col(c)).over(self.rows(UNBOUNDED_BACK, 0))

    def ffill(self, c: Column | str) -> Column:
        return F.last(col(c), ignorenulls=True).over(self.rows(UNBOUNDED_BACK, 0))

    def bfill(self, c: Column | str) -> Column:
        back = Window.partitionBy(*self.by).orderBy(F.desc(self.on)).rowsBetween(UNBOUNDED_BACK, 0)
        return F.last(col(c), ignorenulls=True).over(back)

    def zscore(self, c: Column | str, n: int = 252, min_count: int = 63) -> Column:
        mean = self.roll(F.avg, c, n, min_count)
        std = self.roll(F.stddev_samp, c, n, min_count)
        return safe_ratio(col(c) - mean, std)


MARKET = Axis(by=(), on="d")


def pct_change(df: DataFrame, axis: Axis, spec: dict[str, tuple[str, int]], fill: str | None = None) -> DataFrame:
    """Add ``{out: (column, n)}`` relative changes; ``fill="pad"`` carries the last value over gaps first."""
    if fill is None:
        return df.withColumns({out: axis.pct_change(c, n) for out, (c, n) in spec.items()})
    if fill != "pad":
        raise ValueError("fill must be None or 'pad'")
    used = sorted({c for c, _ in spec.values()})
    padded = df.withColumns({f"_pad_{c}": axis.ffill(c) for c in used})
    out = padded.withColumns({o: axis.pct_change(f"_pad_{c}", n) for o, (c, n) in spec.items()})
    return out.drop(*[f"_pad_{c}" for c in used])


def rolling_means(df: DataFrame, axis: Axis, c: str, spans: dict[str, int], digits: int = 4) -> DataFrame:
    """Full-window means of a column published at ``digits`` decimals, by exact prefix sums.

    The column is taken in integer units of its last digit, so one running sum serves every span, costs the same
    per row whatever the span, and has no rounding drift or dependence on the order of addition.
    """
    unit = 10**digits
    base = df.withColumns({"_u": F.round(F.col(c) * unit).cast("bigint")})
    base = base.withColumns({"_s": axis.running(F.sum, "_u"), "_c": axis.running(F.count, "_u")})
    zero = F.lit(0).cast("bigint")

    def mean(n: int) -> Column:
        total = F.coalesce("_s", zero) - F.coalesce(axis.shift("_s", n), zero)
        count = F.col("_c") - F.coalesce(axis.shift("_c", n), zero)
        return F.when(count >= n, total.cast("double") / F.lit(float(n * unit)))

    return base.withColumns({out: mean(n) for out, n in spans.items()}).drop("_u", "_s", "_c")


def rolling_extremes(
    df: DataFrame, axis: Axis, spec: dict[str, tuple[str, str]], n: int = 252, min_count: int = 1
) -> DataFrame:
    """Rolling ``max``/``min`` over long windows without re-reading the window at every row.

    Rows are cut into blocks of a quarter window. A window is then the running extreme of the current block, the
    extreme of the three blocks before it (a frame over the block number, evaluated once per block) and the
    extreme from a position to the end of its block. ``spec`` maps an output to (``"max"``/``"min"``, column).
    """
    if n % 4:
        raise ValueError("window length must be a multiple of 4")
    size = n // 4
    block = F.floor((F.row_number().over(axis.ordered()) - 1) / F.lit(size)).cast("int")
    cut = df.withColumn("_b", block)
    inner = Window.partitionBy(*axis.by, "_b").orderBy(axis.on)
    rest = Window.partitionBy(*axis.by, "_b").orderBy(F.desc(axis.on)).rowsBetween(UNBOUNDED_BACK, 0)
    before = Window.partitionBy(*axis.by).orderBy("_b").rangeBetween(-3, -1)
    cols: dict[str, Column] = {}
    for out, (kind, c) in spec.items():
        fn = {"max": F.max, "min": F.min}[kind]
        cols[f"_p_{out}"] = fn(c).over(inner.rowsBetween(UNBOUNDED_BACK, 0))
        cols[f"_t_{out}"] = fn(c).over(rest)
        cols[f"_m_{out}"] = fn(c).over(before)
        cols[f"_c_{out}"] = axis.running(F.count, c)
    cut = cut.withColumns(cols)
    res: dict[str, Column] = {}
    for out, (kind, _) in spec.items():
        pick = F.greatest if kind == "max" else F.least
        count = F.col(f"_c_{out}") - F.coalesce(axis.shift(f"_c_{out}", n), F.lit(0))
        value = pick(F.col(f"_p_{out}"), F.col(f"_m_{out}"), axis.shift(f"_t_{out}", n - 1))
        res[out] = F.when(count >= min_count, value)
    return cut.withColumns(res).drop("_b", *cols)


def drawdown(df: DataFrame, axis: Axis, value: str, out: str = "drawdown") -> DataFrame:
    """Relative distance from the running maximum."""
    return df.withColumn(out, safe_ratio(value, axis.running(F.max, value)) - 1)
