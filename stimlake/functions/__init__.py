"""Scalar functions of the models, as column expressions; ``register`` makes them callable from SQL."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def sigmoid(x: Column, a: float, b: float, c: float) -> Column:
    """c / (1 + exp(-a (x - b)))."""
    return F.lit(c) / (1 + F.exp(-F.lit(a) * (x - F.lit(b))))


def relu(x: Column, least: float, most: float = 10_000.0) -> Column:
    return F.least(F.greatest(x, F.lit(float(least))), F.lit(float(most)))


def weighted(xs: Sequence[Column], ws: Sequence[float]) -> Column:
    out = F.lit(0.0)
    for x, w in zip(xs, ws):
        out = out + x * float(w)
    return out


def gaussian(x: Column, mu: float, sigma: float) -> Column:
    """The normal density."""
    return F.exp(-((x - mu) ** 2) / (2 * sigma**2)) / (sigma * math.sqrt(2 * math.pi))


def gaussian_with_offset(x: Column, height: float, mu: float, sigma: float, offset: float) -> Column:
    return height * F.exp(-((x - mu) ** 2) / (2 * sigma**2)) + offset


def logistic(x: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-a * (x - b)))


def decay(t: Column, tau: float, t0: float = 0.0) -> Column:
    """An exponential decay switched on at t0, where it counts half."""
    return F.exp(-t / tau) / tau * 0.5 * (F.signum(t - t0) + 1)


def unit_vector(v: Column) -> Column:
    """The array over its length; null for a zero vector."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(n > 0, F.transform(v, lambda x: x / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def angle_unsigned(a: Column, b: Column) -> Column:
    """Angle between two arrays in degrees; null for a zero vector."""
    cos = dot(unit_vector(a), unit_vector(b))
    return F.degrees(F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0))))


def neuropil_corrected(f: Column, surround: Column, share: float = 0.7) -> Column:
    """Fluorescence of a cell less a share of that of its surround."""
    return f - share * surround


def finite_top(x: Column, fallback: float = 1.0) -> Column:
    """Aggregate: the greatest |x| that is a finite number, the fallback where it is 0 or there is none."""
    top = F.max(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.abs(x)))
    return F.when(top > 0, top).otherwise(F.lit(fallback))


def pi_label(x: Column) -> Column:
    """A multiple of pi as text."""
    n = F.round(x / math.pi).cast("int")
    return F.when(n == 0, "0").when(n == 1, "π").when(n == -1, "-π").otherwise(F.concat(n.cast("string"), F.lit("π")))


def to_byte(x: Column, lo: Column, hi: Column, bits: int = 8) -> Column:
    """A value clipped to lo..hi and scaled to 0..2^bits - 1, cut to an integer."""
    return (F.greatest(F.least((x - lo) / (hi - lo), F.lit(1.0)), F.lit(0.0)) * (2**bits - 1)).cast("int")


#: SQL bodies of the functions that SQL users get.
SQL_FUNCTIONS = {
    "sl_sigmoid(x DOUBLE, a DOUBLE, b DOUBLE, c DOUBLE)": "c / (1 + exp(-a * (x - b)))",
    "sl_relu(x DOUBLE, least_ DOUBLE)": "least(greatest(x, least_), 10000D)",
    "sl_logistic(x DOUBLE, a DOUBLE, b DOUBLE)": "1 / (1 + exp(-a * (x - b)))",
    "sl_gaussian(x DOUBLE, mu DOUBLE, sigma DOUBLE)": "exp(-(x - mu) * (x - mu) / (2 * sigma * sigma)) / (sigma * sqrt(2 * pi()))",
    "sl_decay(t DOUBLE, tau DOUBLE, t0 DOUBLE)": "exp(-t / tau) / tau * 0.5 * (signum(t - t0) + 1)",
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions; returns their names."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")
    return [h.split("(")[0] for h in SQL_FUNCTIONS]
