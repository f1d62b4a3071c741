"""Cleaning and parsing expressions. All stay inside code generation; unparsable input becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that stands for a missing number.
MISSING_TOKENS = ("", "-", "--", "nc", "na", "n/a", "nan", "null", "none")


def sentinel_to_null(x: Column, sentinel: float = -9999.0) -> Column:
    return F.nullif(x, F.lit(sentinel))


def finite(x: Column) -> Column:
    """NULL for NaN and infinities: Spark's aggregates treat NaN as the largest value."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def lenient_double(x: Column) -> Column:
    """A plain number in text, or NULL; thousands separators do not parse."""
    return finite(F.trim(x.cast("string")).try_cast("double"))


def censored_double(x: Column) -> Column:
    """``<v`` is v/2, ``>v`` is v, ``1,234`` is 1234, missing tokens are NULL."""
    t = F.regexp_replace(F.trim(x.cast("string")), ",", "")
    bare = lenient_double(F.regexp_replace(t, r"^[<>]=?\s*", ""))
    parsed = F.when(t.startswith("<"), bare / 2).otherwise(bare)
    return F.when(~F.lower(t).isin(*MISSING_TOKENS), parsed)


def lenient_date(x: Column, fmt: str | None = None) -> Column:
    return F.to_date(F.try_to_timestamp(x, F.lit(fmt))) if fmt else F.to_date(F.try_to_timestamp(x))


def mid_month(year: Column, month: Column) -> Column:
    """The 15th of a month; NULL for a month outside 1 to 12."""
    y, m = year.cast("int"), month.cast("int")
    return F.when((m >= 1) & (m <= 12), F.make_date(y, m, F.lit(15)))


def squeeze(x: Column) -> Column:
    """Trimmed, with each run of white space as one space."""
    return F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), " +", " ")


def name_token(x: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def composite_key(*parts: Column, sep: str = "||") -> Column:
    return F.concat_ws(sep, *(F.trim(p.cast("string")) for p in parts))


def exceeds(y: Column, threshold: float) -> Column:
    """1.0 or 0.0 by y >= threshold; NULL stays NULL."""
    return F.when(y.isNotNull(), (y >= threshold).cast("double"))


def seasonal_key(yyyymm: Column) -> Column:
    """The same month of the year before, for YYYYMM integers."""
    return yyyymm - 100
