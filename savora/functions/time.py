"""Time and rounding helpers: whole 24-hour periods, never calendar days."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def instant(now: datetime) -> Column:
    return F.lit(f"{now:%Y-%m-%d %H:%M:%S.%f}").cast("timestamp")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole 24-hour periods, rounded down."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(DAY)).cast("long")


def rnd(x: Column, n: int) -> Column:
    """Half-even rounding of the double's exact value, as Python rounds: 2.675 lies below its decimal and becomes 2.67.

    Places between two results are odd multiples of half a step. The distance to the nearest multiple q of half a step is
    taken exactly: the upper 24 bits of x and the rest each times the scale fit in a double, and only the sign counts.
    """
    scale = F.lit(float(2 * 10**n))
    upper, q = x.cast("float").cast("double"), F.rint(x * scale)
    beyond = F.signum((upper * scale - q) + (x - upper) * scale)
    return F.rint((q + beyond / 2) / 2) / F.lit(float(10**n)) + F.lit(0.0)


def rnd_of(name: str, n: int) -> Column:
    """``rnd`` of a column that is there already, as one expression text: quick to build and small to plan."""
    x, scale = f"`{name}`", f"{float(2 * 10**n)!r}D"
    upper = f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"
    q = f"rint({x} * {scale})"
    return F.expr(f"rint(({q} + signum(({upper} * {scale} - {q}) + ({x} - {upper}) * {scale}) / 2.0D) / 2.0D) / {float(10**n)!r}D + 0.0D")
