"""Column expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def num(c: Column | str) -> Column:
    """Double at the output boundary; sums before it stay decimal and exact."""
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def total(c: Column | str) -> Column:
    """Sum that is 0, not null, when every input is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c), F.lit(0).cast(MONEY))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double, 0 when b is 0 or either side is missing."""
    return F.coalesce(F.try_divide(num(a), num(b)), F.lit(0.0))


def change(cur: Column | str, prev: Column | str) -> Column:
    """Relative change against |prev|; from a zero base 0 if unchanged, else null."""
    cur, prev = num(cur), num(prev)
    return F.when(prev != 0, (cur - prev) / F.abs(prev)).when(cur == 0, F.lit(0.0))


def whole_days(start: Column | str, end: Column | str) -> Column:
    """Completed 24-hour days between two timestamps."""
    return F.timestamp_diff("DAY", start, end)


def cents(c: Column | str) -> Column:
    """Half-even rounding to 2 places, without a negative zero."""
    return F.bround(num(c), 2) + F.lit(0.0)


def fixed(c: Column | str, digits: int) -> Column:
    """Text with ``digits`` places, rounding the exact binary value half to even.

    ``format_string`` rounds the shortest decimal form half up instead, which differs
    for values such as 43.05.  The value is split into two parts whose products with
    the power of ten are exact, so that ties are recognised exactly.
    """
    value = num(c)
    size, scale = F.abs(value), F.lit(float(10**digits))
    grid = F.lit(float(2**20))
    high = F.floor(size * grid).cast("double") / grid
    low_part, high_part = (size - high) * scale, high * scale
    whole = F.floor(high_part).cast("double")
    over = high_part - whole - 0.5
    up = (over > -low_part) | ((over == -low_part) & (whole % 2 == 1))
    text = F.format_string(f"%.{digits}f", (whole + up.cast("double")) / scale)
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


def percent(c: Column | str, digits: int = 1) -> Column:
    return F.concat(fixed(num(c) * 100, digits), F.lit("%"))


def month_label(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM")


def month_length(c: Column | str) -> Column:
    return F.dayofmonth(F.last_day(c))
