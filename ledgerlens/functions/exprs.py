"""Pure ``Column`` helpers shared by every operator.

All of them are built-in Catalyst expressions, so they stay inside whole-stage
codegen; none is a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def whole_days(start, end) -> Column:
    """Whole days from ``start`` to ``end``, floored (-0.75 d -> -1).

    The difference of two zone-less timestamps is a day-time interval of
    exactly that many microseconds, so neither the session zone nor a
    daylight-saving change can shift the count.
    """
    elapsed = _c(end).cast("timestamp_ntz") - _c(start).cast("timestamp_ntz")
    # interval -> DECIMAL seconds with all six digits, so the floor is exact
    return F.floor(elapsed.cast("interval second").cast("decimal(20,6)") / F.lit(86400)).cast("bigint")


def week_label(ts) -> Column:
    """Monday-to-Sunday label ``yyyy-MM-dd/yyyy-MM-dd`` of the week holding ``ts``."""
    monday = F.to_date(F.date_trunc("week", _c(ts)))
    return F.concat(
        F.date_format(monday, "yyyy-MM-dd"),
        F.lit("/"),
        F.date_format(F.date_add(monday, 6), "yyyy-MM-dd"),
    )


def month_label(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def guarded_ratio(num, den, scale: float = 1.0, when_zero=0.0, zero_test=None) -> Column:
    """``num / den * scale``, or ``when_zero`` if the denominator is zero.

    ANSI mode raises on ``x / 0``; the guard keeps a null denominator null
    (``null == 0`` is unknown, so the ratio itself evaluates to null).
    ``zero_test`` replaces the default ``den == 0`` test (e.g. ``den <= 0``).
    """
    n = _c(num).cast("double")
    d = _c(den).cast("double")
    test = zero_test if zero_test is not None else (d == 0)
    value = n / d
    if scale != 1.0:
        value = value * F.lit(float(scale))
    return F.when(test, F.lit(when_zero).cast("double")).otherwise(value)


def safe_division(num, den) -> Column:
    """Scalar-style division: 0.0 for a zero/null denominator or a null numerator."""
    return F.coalesce(F.try_divide(_c(num).cast("double"), _c(den).cast("double")), F.lit(0.0))


def _fixed(x, decimals: int, grouping: bool) -> Column:
    """Fixed-point text rounded half-to-even on the exact binary value (the
    rounding of ``format(x, ',.2f')``); ``grouping`` adds thousands separators."""
    text = F.format_number(_c(x).cast("double"), decimals)
    return text if grouping else F.regexp_replace(text, ",", "")


def format_amount(x, suffix: str = "", decimals: int = 2) -> Column:
    """Presentation text: thousands separators, fixed decimals, optional suffix."""
    text = _fixed(x, decimals, True)
    return F.concat(text, F.lit(suffix)) if suffix else text


def format_percent(x, decimals: int = 2) -> Column:
    return F.concat(_fixed(x, decimals, False), F.lit("%"))


# KPI text styles (suffixes as displayed).
KPI_STYLES = ("amount", "percent", "multiple", "days", "count")


def format_kpi(x, kind: str) -> Column:
    """KPI text in the display styles: amount (``1,234.50 SAR``),
    percent (``12.34%``), multiple (``2.50x``), days (``3.25 Days``),
    count (``1,234``). A null value shows as ``-``."""
    if kind == "amount":
        text = format_amount(x, " SAR")
    elif kind == "percent":
        text = format_percent(x)
    elif kind == "multiple":
        text = F.concat(_fixed(x, 2, False), F.lit("x"))
    elif kind == "days":
        text = F.concat(_fixed(x, 2, False), F.lit(" Days"))
    elif kind == "count":
        text = _fixed(x, 0, True)
    else:
        raise ValueError(f"unknown KPI format {kind!r}")
    return F.coalesce(text, F.lit("-"))


def with_kpi_text(df, styles: dict):
    """Add ``<column>_text`` for each ``{column: style}``; numbers stay primary."""
    return df.select("*", *[format_kpi(c, kind).alias(f"{c}_text") for c, kind in styles.items()])


def date_in_range(date_col, start=None, end=None, ts_col=None) -> Column:
    """Inclusive calendar-date range. With ``ts_col`` the same bounds are also
    stated on the raw timestamp so that Parquet row-group statistics apply."""
    cond = F.lit(True)
    d = _c(date_col)
    if start is not None:
        cond = cond & (d >= F.to_date(F.lit(str(start))))
        if ts_col is not None:
            cond = cond & (_c(ts_col) >= F.to_timestamp_ntz(F.lit(f"{start} 00:00:00")))
    if end is not None:
        cond = cond & (d <= F.to_date(F.lit(str(end))))
        if ts_col is not None:
            cond = cond & (_c(ts_col) < F.to_timestamp_ntz(F.lit(f"{end} 00:00:00")) + F.expr("INTERVAL 1 DAY"))
    if start is None and end is None:
        return d.isNotNull()
    return cond
