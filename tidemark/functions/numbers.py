"""Number and array functions: binary fractions, segments, sums over arrays, frequency statistics."""

from __future__ import annotations

import math
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, functions as F


def int_frac(n: Column, fraction: float) -> Column:
    """The whole part of n times a fraction in binary floating point, as Python's int(n * fraction)."""
    return F.floor(n * F.lit(float(fraction))).cast("int")


def long_floor(value: Column, complaint: str) -> Column:
    """The floor of a number as a long; one that no long holds fails the job, where floor gives the nearest long."""
    beyond = (value < -(2.0**63)) | (value >= 2.0**63)
    return F.when(beyond, F.raise_error(F.lit(complaint)).cast("long")).otherwise(F.floor(value).cast("long"))


def long_sum(value: Column) -> Column:
    """The sum of longs as a decimal, also where no long holds it: upper and lower 32 bits are summed apart, in longs."""
    upper, lower = F.sum(F.shiftright(value, 32)), F.sum(value.bitwiseAND(F.lit(2**32 - 1)))
    return upper.cast("decimal(19,0)") * Decimal(2**32) + lower.cast("decimal(19,0)")


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def array_mean(values: Column) -> Column:
    return array_sum(values) / F.size(values)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def moving_average(values: Column, kernel: int) -> Column:
    """Centred mean with an odd kernel; the ends are repeated beyond the edges."""
    half = kernel // 2
    padded = F.concat(F.array_repeat(values[0], half), values, F.array_repeat(F.element_at(values, -1), half))
    return F.transform(F.sequence(F.lit(1), F.size(values)), lambda k: array_mean(F.slice(padded, k, F.lit(kernel))))


def ffill_array(values: Column) -> Column:
    """Each null replaced by the value before it, 0 where there is none."""
    start = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))
    step = lambda a, x: F.struct(F.coalesce(x, a["last"]).alias("last"), F.concat(a["out"], F.array(F.coalesce(x, a["last"]))).alias("out"))
    return F.aggregate(values, start, step, lambda a: a["out"])


def spectrum(x: Column, length: int) -> Column:
    """Powers of the real discrete Fourier transform of an array of fixed length: length // 2 + 1 bins."""

    def power(k: int) -> Column:
        wave = lambda f: F.array(*(F.lit(f(2 * math.pi * k * t / length)) for t in range(length)))
        re, im = dot(x, wave(math.cos)), dot(x, wave(math.sin))
        return re * re + im * im

    return F.array(*(power(k) for k in range(length // 2 + 1)))


def once(value: Column, f) -> Column:
    """f(value), with the value as a lambda's variable: worked out once a row, however often f names it."""
    return F.transform(F.array(value), f)[0]


def shares(power: Column) -> Column:
    return F.transform(power, lambda p: p / F.greatest(array_sum(power), F.lit(1e-8)))


def frequency_array(x: Column, length: int) -> Column:
    """The ten frequency statistics of a window of fixed length, as an array. The window, its powers, their shares and the steps are variables of
    lambdas, so that each is worked out once a row."""
    bins = length // 2 + 1
    return once(x, lambda w: once(spectrum(w, length), lambda power: once(shares(power), lambda share: F.array(*frequency_statistics(w, power, bins, share).values()))))


def frequency_statistics(x: Column, power: Column, bins: int, share: Column | None = None) -> dict[str, Column]:
    """Ten statistics of a window x with powers of so many bins, and their shares, in their fixed order.

    Shares of power in four bands, centroid, entropy over its maximum, the strongest bin but the first over the last,
    the greatest share, the rise from first to last value, and the population deviation of the steps.
    """
    share = shares(power) if share is None else share
    edges = [int(k * bins / 4) for k in range(5)]
    bands = {f"band{k}": array_sum(F.slice(share, lo + 1, hi - lo)) for k, (lo, hi) in enumerate(zip(edges, edges[1:]), 1)}
    last = max(1, bins - 1)
    others = F.slice(power, 2, last)
    steps = F.zip_with(F.slice(x, F.lit(2), F.size(x) - 1), F.slice(x, F.lit(1), F.size(x) - 1), lambda b, a: b - a)
    return bands | {
        "centroid": array_sum(F.zip_with(share, F.array(*(F.lit(k / last) for k in range(bins))), lambda s, f: s * f)),
        "entropy": -array_sum(F.transform(share, lambda s: s * F.log(F.greatest(s, F.lit(1e-12))))) / math.log(max(2, bins)),
        "dominant": F.array_position(others, F.array_max(others)).cast("double") / last if bins > 1 else F.lit(0.0),
        "concentration": F.array_max(share),
        "slope": F.element_at(x, -1) - x[0],
        "volatility": once(steps, lambda s: once(array_mean(s), lambda mean: F.sqrt(array_mean(F.transform(s, lambda d: (d - mean) * (d - mean)))))),
    }


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
