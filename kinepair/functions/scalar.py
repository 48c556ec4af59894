"""Scalar column expressions: angles, finiteness, hashing, ramps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def angle_diff(a: Column, b: Column) -> Column:
    """a - b wrapped to (-pi, pi]."""
    return F.atan2(F.sin(a - b), F.cos(a - b))


def abs_angle_diff(a: Column, b: Column) -> Column:
    return F.abs(angle_diff(a, b))


def norm2(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def unwrap_correction(step: Column) -> Column:
    """Multiple of 2*pi that brings one heading step into (-pi, pi]."""
    pi = math.pi
    wrapped = F.pmod(step + F.lit(pi), F.lit(2 * pi)) - F.lit(pi)
    wrapped = F.when((wrapped == F.lit(-pi)) & (step > 0), F.lit(pi)).otherwise(wrapped)
    return F.when(F.abs(step) < F.lit(pi), F.lit(0.0)).otherwise(wrapped - step)


def hash_prefix(text: Column) -> Column:
    """First eight bytes of SHA-256 as an exact unsigned integer."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_fraction(seed: int, *parts: Column) -> Column:
    """Stable number in [0, 1) from seed and parts, joined by NUL bytes."""
    text = F.concat_ws("\0", F.lit(str(int(seed))), *parts)
    return hash_prefix(text).cast("double") / F.lit(float(2**64))


def minimum_jerk(step: Column, window: Column) -> Column:
    """Progress at step 1..window; 0 before, exactly 1 at the end."""
    tau = step.cast("double") / window.cast("double")
    value = 10.0 * tau * tau * tau - 15.0 * tau * tau * tau * tau + 6.0 * tau * tau * tau * tau * tau
    return F.when(step <= 0, F.lit(0.0)).when(step >= window, F.lit(1.0)).otherwise(value)


def motion_regime(min_speed: Column) -> Column:
    """Speed regime of a pair; NULL for NaN, infinite or negative speeds."""
    from kinepair.config import MOVING_REGIME, REGIME_SPEED_MPS, SLOW_REGIME

    return F.when(finite(min_speed) & (min_speed >= 0),
                  F.when(min_speed < F.lit(REGIME_SPEED_MPS), F.lit(SLOW_REGIME))
                  .otherwise(F.lit(MOVING_REGIME)))


def strict_boolean(text: Column, words: tuple[str, ...] = ("1", "true", "yes", "0", "false", "no")) -> Column:
    """Boolean for an accepted word, NULL for anything else."""
    word = F.lower(F.trim(text.cast("string")))
    yes = [w for w in words if w in ("1", "true", "yes")]
    return F.when(word.isin(*words), word.isin(*yes))


def strict_integer(c: Column) -> Column:
    """Whole number as bigint, NULL for fractions, text or non-finite values."""
    number = c.cast("string").try_cast("double")
    return F.when(finite(number) & (number == F.floor(number)), number.cast("bigint"))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL for an empty denominator."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
