"""Report formatting: fixed 3-decimal floats, ``-`` for missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the placeholder printed for a missing value.
MISSING = "-"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fmt_float(c, decimals: int = 3) -> Column:
    """``'%.3f'`` of a double, ``-`` for null.

    The double goes through ``decimal(38, 10)`` (its shortest decimal form)
    and is rounded half-up there, so the digits do not depend on how a
    formatter treats the binary value (the reference's formatter rounds
    half-even on the binary value: 0.5065 prints ``0.506`` there, ``0.507``
    here). NaN and the infinities print ``nan``, ``inf`` and ``-inf``; from
    1e28 on, where the decimal ends, the shortest decimal form is written out
    with zeros.
    """
    v = _col(c).cast("double")
    fixed = F.round(v.try_cast("decimal(38,10)"), decimals).try_cast(f"decimal(38,{decimals})")
    return (F.when(v.isNull(), F.lit(MISSING))
            .when(F.isnan(v), F.lit("nan"))
            .when(F.abs(v) == float("inf"), F.when(v > 0, F.lit("inf")).otherwise(F.lit("-inf")))
            .otherwise(F.coalesce(fixed.cast("string"), F.format_string(f"%.{decimals}f", v))))


def fmt_plain(c) -> Column:
    """``str(value)`` for ints and strings, ``-`` for null."""
    return F.coalesce(_col(c).cast("string"), F.lit(MISSING))
