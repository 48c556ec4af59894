"""Statistics of short array columns.

A track never has more than 110 samples, so its series live in array columns:
one row per track or pair, no extra shuffle, no sort. `bind` names an
intermediate value inside an expression, so a series is evaluated once however
often a formula refers to it, also after the optimizer has merged projections
or pushed a filter through them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def moments(points: Column, y: str) -> Column:
    """Struct (mean, std) of field y in one pass, population std, zeros if empty.

    Values are shifted by the first one, so a constant series gives std 0.
    """

    def body(pts: Column) -> Column:
        n = F.size(pts)
        shift = F.get(pts, F.lit(0))[y]
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"))
        result = F.aggregate(
            pts, zero,
            lambda acc, p: F.struct((acc["s"] + (p[y] - shift)).alias("s"),
                                    (acc["ss"] + (p[y] - shift) * (p[y] - shift)).alias("ss")),
            lambda acc: F.struct(
                (shift + acc["s"] / n).alias("mean"),
                F.sqrt(F.greatest(acc["ss"] / n - (acc["s"] / n) * (acc["s"] / n), F.lit(0.0))).alias("std")))
        return F.when(n > 0, result).otherwise(F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("std")))

    return bind(points, body)


def slope(points: Column, y: str, t: str = "t") -> Column:
    """Least-squares slope of field y over field t in one pass, 0 without spread."""

    def body(pts: Column) -> Column:
        n = F.size(pts)
        first = F.get(pts, F.lit(0))
        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("st", "sy", "stt", "sty")])

        def step(acc: Column, p: Column) -> Column:
            dt = (p[t] - first[t]).cast("double")
            dy = p[y] - first[y]
            return F.struct((acc["st"] + dt).alias("st"), (acc["sy"] + dy).alias("sy"),
                            (acc["stt"] + dt * dt).alias("stt"), (acc["sty"] + dt * dy).alias("sty"))

        def finish(acc: Column) -> Column:
            spread = acc["stt"] - acc["st"] * acc["st"] / n
            return F.when(spread < F.lit(1e-6), F.lit(0.0)).otherwise(
                (acc["sty"] - acc["st"] * acc["sy"] / n) / spread)

        return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(pts, zero, step, finish))

    return bind(points, body)


def quantile(ordered: Column, p: float) -> Column:
    """Interpolated quantile of a sorted array (a bound value)."""
    pos = F.lit(p) * (F.size(ordered) - 1)
    low = F.floor(pos).cast("int")
    below = F.get(ordered, low)
    above = F.coalesce(F.get(ordered, low + 1), below)
    return below + (above - below) * (pos - low)


def steps(arr: Column) -> Column:
    """Absolute first differences."""
    return bind(arr, lambda a: F.when(F.size(a) < 2, empty("double")).otherwise(
        F.zip_with(F.slice(a, F.lit(2), F.size(a) - 1), F.slice(a, F.lit(1), F.size(a) - 1),
                   lambda later, earlier: F.abs(later - earlier))))


def jump_count(values: Column, sigma: float) -> Column:
    """Steps beyond median + sigma * max(1.4826 MAD, IQR / 1.349, 1e-3); 0 for fewer than three values, none of them NULL.

    `sort_array` compares natively; `array_sort` calls a lambda for each comparison, which took most of a track's time.
    """

    def with_centre(d: Column, c: Column) -> Column:
        def with_deviation(dev: Column) -> Column:
            iqr = (quantile(d, 0.75) - quantile(d, 0.25)) / F.lit(1.349)
            scale = F.greatest(F.lit(1.4826) * quantile(dev, 0.5), iqr, F.lit(1e-3))
            return bind(c + F.lit(float(sigma)) * scale, lambda cut: F.size(F.filter(d, lambda v: v > cut)))
        return bind(F.sort_array(F.transform(d, lambda v: F.abs(v - c))), with_deviation)

    return bind(F.sort_array(steps(values)), lambda d: F.when(F.size(d) < 2, F.lit(0)).otherwise(
        bind(quantile(d, 0.5), lambda c: with_centre(d, c))))


def longest_run(flags: Column) -> Column:
    """Length of the longest stretch of true values."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, flag: Column) -> Column:
        return bind(F.when(flag, acc["run"] + 1).otherwise(F.lit(0)), lambda run: F.struct(
            run.alias("run"), F.greatest(acc["best"], run).alias("best")))

    return F.aggregate(flags, zero, step, lambda acc: acc["best"])
