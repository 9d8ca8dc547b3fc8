"""Null-safe arithmetic, rounding and text-to-number helpers (all JVM-side column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_round(c: Column | str, digits: int = 6) -> Column:
    """Round half up by ``floor(x * 10^n + 0.5) / 10^n``.

    The same IEEE operations exist in every SQL engine, so published values are bit-identical
    across engines, which ``round`` on short decimals is not. Values without so many decimals (from 2^52 units on) stay as
    they are: ``floor`` returns a 64-bit integer and would cut them off.
    """
    scale = float(10**digits)
    units = col(c) * F.lit(scale)
    return F.when(F.abs(units) >= F.lit(float(1 << 52)), col(c).cast("double")).otherwise(F.floor(units + F.lit(0.5)) / F.lit(scale))


def half_even(c: Column | str, digits: int) -> Column:
    """Banker's rounding, as used by the data-quality thresholds."""
    return F.bround(col(c), digits)


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` with zero denominators and non-finite results mapped to NULL."""
    q = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return F.when(F.isnan(q) | (F.abs(q) == F.lit(float("inf"))), None).otherwise(q)


def safe_ln(c: Column | str) -> Column:
    return F.when(col(c) > 0, F.ln(col(c)))


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp a value; NULL stays NULL (``greatest``/``least`` would skip it)."""
    x = col(c)
    out = x
    if lo is not None:
        out = F.when(out < lo, F.lit(float(lo))).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, F.lit(float(hi))).otherwise(out)
    return out


def nullify_nan(df: DataFrame) -> DataFrame:
    """Map NaN and infinities to NULL in every floating column; the engine is NULL-only."""
    fixed = {
        f.name: F.when(F.isnan(f.name) | (F.abs(F.col(f.name)) == F.lit(float("inf"))), None).otherwise(
            F.col(f.name)
        )
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixed) if fixed else df


def coerce_numeric(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cast text columns to double where they parse, except the named ones."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keep]
    return df.withColumns({c: F.col(c).try_cast("double") for c in texts}) if texts else df


# Characters dropped from scraped numbers and the texts that mean "no value".
NUMBER_NOISE = ",%₹ +"
BLANK_NUMBERS = ("", "--", "-", "N/A")


def clean_number(c: Column | str) -> Column:
    """Scraped text to double: drop separators and currency/percent signs, blanks to NULL."""
    text = F.trim(F.translate(col(c).cast("string"), NUMBER_NOISE, ""))
    return F.when(~text.isin(*BLANK_NUMBERS), text.try_cast("double"))


# Three-letter month names in calendar order.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def month_number(c: Column | str) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), col(c)), F.lit(0)).cast("int")


def period_start(c: Column | str) -> Column:
    """``Mon YYYY`` label (also with a glued suffix such as ``Mar 20249m``) to the first day of the month.

    Trailing-twelve-month labels and anything else give NULL.
    """
    pattern = r"^(" + "|".join(MONTHS) + r")\s+(\d{4})\d*[a-zA-Z]*$"
    text = F.trim(col(c))
    year = F.regexp_extract(text, pattern, 2)
    return F.when(
        year != "", F.make_date(year.try_cast("int"), month_number(F.regexp_extract(text, pattern, 1)), F.lit(1))
    )


def bare_ticker(c: Column | str, suffix: str = ".NS") -> Column:
    """Drop an exchange suffix."""
    x = col(c)
    return F.when(x.endswith(suffix), F.left(x, F.length(x) - F.lit(len(suffix)))).otherwise(x)


# Coefficients of the published rational approximation of the inverse normal
# distribution (Acklam), valid on (0, 1) with relative error below 1.2e-9.
NORM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
          1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
NORM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
          6.680131188771972e01, -1.328068155288572e01)
NORM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
          -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
NORM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
NORM_SPLIT = 0.02425


def _horner(x: Column, coeffs: tuple[float, ...]) -> Column:
    out = F.lit(coeffs[0])
    for k in coeffs[1:]:
        out = out * x + F.lit(k)
    return out


def norm_ppf(p: Column | str) -> Column:
    """Inverse standard normal distribution as a column expression.

    The argument is bound once through a lambda, because the formula uses it many times.
    """

    def tail(u: Column) -> Column:
        return _horner(u, NORM_C) / (_horner(u, NORM_D) * u + 1.0)

    def formula(x: Column) -> Column:
        q = x - 0.5
        r = q * q
        middle = _horner(r, NORM_A) * q / (_horner(r, NORM_B) * r + 1.0)
        low = tail(F.sqrt(F.lit(-2.0) * F.ln(x)))
        high = -tail(F.sqrt(F.lit(-2.0) * F.ln(1.0 - x)))
        return F.when(x < NORM_SPLIT, low).when(x > 1 - NORM_SPLIT, high).otherwise(middle)

    return F.transform(F.array(col(p)), formula)[0]
