"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NaN -> NULL, so that 'x > 0' and 'dropna' behave as in the reference."""
    c = col(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def clean_double(c: Column | str) -> Column:
    return nan_to_null(col(c).cast("double"))


def pct_of(part: Column, whole: Column) -> Column:
    """100 * part / whole as double; NULL when whole is 0 (never raises)."""
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))


def delta_pct(delta: Column, base: Column) -> Column:
    """Relative change in percent; 0 when the base is 0 (reference rule)."""
    return F.when(base != 0, delta / base * F.lit(100.0)).otherwise(F.lit(0.0))


#: Relative step that carries a double on or just below a rounding midpoint across it, away from zero.
NUDGE = 1.0 + 1e-12


def round_half_up(c: Column | str, digits: int) -> Column:
    """ROUND to `digits`, half away from zero, whatever the last bits of a double sum.

    A mean depends on the order of its sum, so one that lies on a midpoint (27.455) may come out
    a few units in the last place below it. The step is relative: signs, infinities and small values stay.
    """
    return F.round(col(c) * F.lit(NUDGE), digits)


def rounded_avg(c: Column | str, digits: int) -> Column:
    return round_half_up(F.avg(col(c)), digits)
