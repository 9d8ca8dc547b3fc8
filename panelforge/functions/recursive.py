"""Recursive smoothers and long rolling co-moments as Arrow grouped maps.

A recursion cannot be written as a window frame, and Spark's sliding frames re-read the whole window at every row,
which for eight 252-row covariances costs thousands of updates per row. Both are linear scans in pandas. Spark
shuffles by entity; a group is one entity's history, bounded by the calendar (one row per date).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelforge.functions.windows import Axis

#: Output columns, input columns, and the function from the inputs in date order to the outputs.
Step = tuple[Sequence[str], Sequence[str], Callable[[pd.DataFrame], dict[str, pd.Series]]]


def grouped(df: DataFrame, axis: Axis, steps: Sequence[Step]) -> DataFrame:
    """Add double columns computed per entity in date order; all steps share one pass over the data.

    Rows stay in Arrow; only the steps' inputs become pandas columns.
    """
    added = [name for names, _, _ in steps for name in names]
    inputs = list(dict.fromkeys(c for _, needed, _ in steps for c in needed))
    schema = T.StructType(df.schema.fields + [T.StructField(c, T.DoubleType()) for c in added])
    on = axis.on

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(on)
        pdf = rows.select(inputs).to_pandas()
        for _, _, fn in steps:
            for name, values in fn(pdf).items():
                x = values.to_numpy(dtype="float64", na_value=np.nan)
                rows = rows.append_column(name, pa.array(x, pa.float64(), mask=~np.isfinite(x)))
        return rows

    return df.groupBy(*axis.by).applyInArrow(run, schema)


def rolling_beta(y: pd.Series, x: pd.Series, n: int, min_count: int) -> pd.Series:
    """Covariance of complete pairs over the factor's own variance, zero variance giving NaN."""
    y, x = y.astype("float64"), x.astype("float64")
    var = x.rolling(n, min_periods=min_count).var()
    return y.rolling(n, min_periods=min_count).cov(x) / var.where(var != 0)


def beta_step(ret: str, factors: dict[str, str], n: int = 252, min_count: int = 63) -> Step:
    """Rolling sensitivities of ``ret``; ``factors`` maps output to factor column."""
    return tuple(factors), (ret, *factors.values()), lambda pdf: {
        out: rolling_beta(pdf[ret], pdf[f], n, min_count) for out, f in factors.items()
    }


def ema(s: pd.Series, span: int) -> pd.Series:
    """Exponential mean seeded by the first value."""
    return s.ewm(span=span, adjust=False).mean()


def wilder(s: pd.Series, n: int) -> pd.Series:
    """Wilder smoothing: mean of the first ``n`` values, then ``(n-1)/n`` of the old plus ``1/n`` of the new."""
    out = pd.Series(np.nan, index=s.index)
    valid = s.dropna()
    if len(valid) < n:
        return out
    tail = valid.iloc[n - 1:].copy()
    tail.iloc[0] = valid.iloc[:n].mean()
    out.loc[tail.index] = tail.ewm(alpha=1.0 / n, adjust=False).mean()
    return out
