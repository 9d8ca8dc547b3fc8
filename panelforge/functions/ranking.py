"""Exact ranks and order statistics without one task per group.

A group (one date, one sector, or the whole table) may hold any share of the rows and any values, so no rank here sorts a group in one window:

1. rows collapse to (group, value, count) with map-side combine: a value shared by a third of all rows is one row;
2. values take an order-preserving 54-bit form (sign and binary logarithm), whose leading 18 bits are counted per group; a cell of more than ``CELL`` different
   values is counted by the next 18 bits, and where that is still more, by all. Counts are summed over the cells of one level below one
   parent, a bounded number whatever the data, so the rows below a cell are known;
3. positions inside a cell come from a window over the cell: ``CELL`` values at most, or the 1,600 doubles that share all bits of the form.

Neither the spread of the values nor their closeness matters, and every step deals rows by (group, cell). The rank table is then joined back on
(group, value); adaptive execution splits that join where it is skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.numeric import floor_round

#: Different values up to which a cell is ordered in one window.
CELL = 4096
DIGIT, DIGITS = 18, 3


def sort_key(value: Column) -> Column:
    """An integer of 54 bits and a sign that never falls while the double rises; doubles within one part in 6e12 may share it."""
    x = value.cast("double")
    size = F.least(F.log2(F.abs(x)), F.lit(1024.0)) + 1075.0  # from 1 for the smallest number on
    key = (size * float(1 << 42)).cast("long")
    return F.when(x == 0, F.lit(0).cast("long")).when(x < 0, -key).otherwise(key)


def _level(rows: DataFrame, by: Sequence[str], parent: str | None, name: str, base: Column) -> DataFrame:
    """Cells ``name`` of one level: rows before each in its group (``_base``), and whether it has to be split."""
    held = [*by, parent] if parent else list(by)
    cells = rows.groupBy(*held, name).agg(F.sum("_n").alias("_m"), F.count("*").alias("_kinds"), F.first(base).alias("_from"))
    earlier = Window.partitionBy(*held).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    split = F.col("_kinds") > CELL
    before = F.col("_from") + F.coalesce(F.sum("_m").over(earlier), F.lit(0))
    cols = [*by, name, before.alias(f"_base{name}"), split.alias(f"_split{name}")]
    if not parent:
        cols.append(F.sum("_m").over(Window.partitionBy(*held)).alias("_total"))
    return cells.select(*cols)


def position_table(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct non-null values of each group with ``_n`` (copies), ``_before`` (rows below) and ``_total``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumns({f"_p{i + 1}": F.shiftright(sort_key(F.col("_x")), (DIGITS - 1 - i) * DIGIT) for i in range(DIGITS)})
    first = _level(counts, by, None, "_p1", F.lit(0))
    one = counts.join(first, [*by, "_p1"])
    second = _level(one.where("_split_p1"), by, "_p1", "_p2", F.col("_base_p1"))
    two = one.join(second, [*by, "_p2"], "left")
    third = _level(two.where("_split_p2"), by, "_p2", "_p3", F.col("_base_p2"))
    three = two.join(third.drop("_split_p3"), [*by, "_p3"], "left")
    level = F.when(F.col("_base_p3").isNotNull(), 3).when(F.col("_base_p2").isNotNull(), 2).otherwise(1)
    cell = F.coalesce(F.when(level == 3, F.col("_p3")), F.when(level == 2, F.col("_p2")), F.col("_p1"))
    located = three.select(*by, "_x", "_n", "_total", level.alias("_level"), cell.alias("_cell"), F.coalesce("_base_p3", "_base_p2", "_base_p1").alias("_base"))
    inside = Window.partitionBy(*by, "_level", "_cell").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    return located.select(*by, "_x", "_n", before.alias("_before"), "_total")


def average_rank() -> Column:
    """Rank of a value with ties sharing their mean rank, from the position table."""
    return F.col("_before") + (F.col("_n") + 1) / F.lit(2.0)


def rank_pct(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    out: str,
    min_count: int = 1,
    digits: int | None = 6,
) -> DataFrame:
    """Percentile rank (mean rank of ties over non-null count); NULL below ``min_count`` values."""
    ranks = position_table(df, by, value)
    pct = average_rank() / F.col("_total")
    pct = F.when(F.col("_total") >= min_count, pct if digits is None else floor_round(pct, digits))
    ranks = ranks.select(*by, F.col("_x").alias(value), pct.alias(out))
    return df.join(ranks, [*by, value], "left")


def rank_many(
    df: DataFrame,
    keys: Sequence[str],
    specs: Sequence[tuple[str, str, Sequence[str], int]],
    digits: int | None = 6,
) -> DataFrame:
    """Several percentile ranks in one pass: ``specs`` holds (out, value column, group columns, min count).

    Works on a narrow long form, so the cost is one set of shuffles whatever the number of ranks, and the wide
    panel itself is shuffled once for the final join on its keys.
    """
    kinds = dict(df.dtypes)
    slots = list(dict.fromkeys(c for _, _, by, _ in specs for c in by))

    def group(by: Sequence[str]) -> Column:
        """Native group key: a slot for every group column in use, NULL where a rank does not group by it."""
        return F.struct(*[(F.col(c) if c in by else F.lit(None).cast(kinds[c])).alias(c) for c in slots])

    items = F.array(
        *[
            F.struct(
                F.lit(out).alias("_name"),
                group(by).alias("_grp"),
                F.col(value).cast("double").alias("_v"),
            )
            for out, value, by, _ in specs
        ]
    )
    parts = ["_name", "_grp", "_v"]
    long = df.select(*keys, F.explode(items).alias("_item")).select(*keys, *[F.col(f"_item.{c}") for c in parts])
    long = long.where(F.col("_v").isNotNull())
    need = F.create_map(*[F.lit(v) for out, _, _, k in specs for v in (out, k)])
    table = position_table(long, ["_name", "_grp"], "_v")
    pct = average_rank() / F.col("_total")
    ranks = table.where(F.col("_total") >= need[F.col("_name")]).select(
        "_name", "_grp", F.col("_x").alias("_v"), (pct if digits is None else floor_round(pct, digits)).alias("_pct")
    )
    wide = (
        long.join(ranks, parts)
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("_name") == out, F.col("_pct"))).alias(out) for out, *_ in specs])
    )
    return df.join(wide, list(keys), "left")


def order_statistics(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    positions: dict[str, Column],
) -> DataFrame:
    """Exact order statistics: ``positions`` maps an output name to a zero-based row number in terms of ``_total``."""
    table = position_table(df, by, value)
    picks = [
        F.max(
            F.when((F.col("_before") <= p) & (p < F.col("_before") + F.col("_n")), F.col("_x"))
        ).alias(out)
        for out, p in positions.items()
    ]
    return table.groupBy(*by).agg(*picks, F.max("_total").alias("n_values"))


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: dict[str, float],
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, plus ``n_values``."""
    positions: dict[str, Column] = {}
    for out, p in probs.items():
        h = F.lit(p) * (F.col("_total") - 1)
        positions[f"_lo_{out}"] = F.floor(h)
        positions[f"_hi_{out}"] = F.ceil(h)
    stats = order_statistics(df, by, value, positions)
    cols = []
    for out, p in probs.items():
        h = F.lit(p) * (F.col("n_values") - 1)
        lo, hi = F.col(f"_lo_{out}"), F.col(f"_hi_{out}")
        cols.append((lo + (hi - lo) * (h - F.floor(h))).alias(out))
    return stats.select(*by, *cols, "n_values")
