"""Number handling: guarded division, rounding rules, parsing, correlation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division in double; NULL on a zero divisor instead of an error."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def is_finite(x: Column) -> Column:
    """True for a double that is neither NULL, NaN nor infinite (NaN and infinity times 0 are NaN)."""
    return F.coalesce(x * F.lit(0.0) == F.lit(0.0), F.lit(False))


def parse_number(x: Column, default: float | None = 0.0) -> Column:
    """Text to double; anything that is not a finite number becomes ``default``."""
    value = x.cast("string").try_cast("double")
    return F.when(is_finite(value), value).otherwise(F.lit(default).cast("double"))


def checked_cast(x: Column, low: float, high: float, kind: str) -> Column:
    """Cast of the values from ``low`` to ``high``; others are NULL, never wrapped or cut."""
    return F.when(x.between(low, high), x.cast(kind))


def parse_integer(x: Column) -> Column:
    """Text to bigint when it is a whole number, else NULL; exact over the whole range of bigint."""
    text = x.cast("string")
    exact = text.try_cast("decimal(38,9)")
    value = text.try_cast("double")
    return F.coalesce(
        text.try_cast("bigint"),
        F.when(exact == F.floor(exact), exact.try_cast("bigint")),
        F.when(exact.isNull() & is_finite(value) & (value == F.floor(value)), value.try_cast("bigint")),
    )


def round_half_up(x: Column) -> Column:
    """Round to an integer with halves going towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows where both sides are present; NULL when undefined.

    The built-in ``corr`` divides by zero on a constant column under ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    a = F.when(both, x.cast("double"))
    b = F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def bmi(weight_kg: Column, height_cm: Column) -> Column:
    """Body mass index."""
    h = height_cm.cast("double")
    return ratio(weight_kg, h * h / F.lit(10_000.0))


def heart_rate_zone(bpm: Column) -> Column:
    """Training zone by heart rate; upper limits are exclusive."""
    # Zone limits in beats per minute and zone names.
    return (
        F.when(bpm < 120, "z1_recovery")
        .when(bpm < 140, "z2_aerobic")
        .when(bpm < 160, "z3_tempo")
        .when(bpm < 175, "z4_threshold")
        .when(bpm.isNotNull(), "z5_vo2max")
    )
