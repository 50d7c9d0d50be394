"""Smoothing of dense series, and resampling of distributions.

A dense series has an index 0..n-1 without holes in ``i`` (see series.numbered). A kernel is a mapping of
offsets to weights; every row is sent to the places it weighs on and the sums are aggregated with map-side
partials, so no task needs a whole series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stimlake.operators.series import asof, running_total
from stimlake.tables import cut


def convolve(df: DataFrame, keys: Sequence[str], kernel: dict[int, float], *, edge: str = "zero", value: str = "value", full: bool = False) -> DataFrame:
    """``smooth`` at each place i: the sum over offsets o of weight(o) times the value at i + o.

    edge: beyond the ends the series is 'zero', goes on with its 'nearest' value, or is mirrored ('reflect',
    the end counted twice). full keeps the places beyond the ends that the kernel reaches.
    """
    reach = max(abs(o) for o in kernel)
    s = df.select(*keys, F.col("i").cast("long").alias("i"), F.col(value).cast("double").alias("v"))
    if edge != "zero" or not full:
        s = s.join(s.groupBy(*keys).agg(F.count("*").alias("n")), list(keys))
    at = F.array(F.col("i"))
    if edge == "nearest":
        before = F.when(F.col("i") == 0, F.sequence(F.lit(-reach), F.lit(-1)))
        after = F.when(F.col("i") == F.col("n") - 1, F.sequence(F.col("n").cast("int"), (F.col("n") + reach - 1).cast("int")))
        at = F.concat(at, *[F.coalesce(x.cast("array<bigint>"), F.array().cast("array<bigint>")) for x in (before, after)])
    elif edge == "reflect":
        at = F.array_compact(F.array(F.col("i"), F.when(F.col("i") < reach, -1 - F.col("i")), F.when(F.col("i") >= F.col("n") - reach, 2 * F.col("n") - 1 - F.col("i"))))
    taps = F.array(*[F.struct(F.lit(-o).cast("long").alias("d"), F.lit(float(w)).alias("w")) for o, w in kernel.items()])
    e = s.withColumn("at", F.explode(at)).withColumn("tap", F.explode(taps)).withColumn("place", F.col("at") + F.col("tap.d"))
    if not full:
        e = e.filter((F.col("place") >= 0) & (F.col("place") < F.col("n")))
    return e.groupBy(*keys, F.col("place").alias("i")).agg(F.sum(F.col("v") * F.col("tap.w")).alias("smooth"))


def trailing(n: int) -> dict[int, float]:
    """The sum of the last n values over n: the first places are partial sums."""
    return {-k: 1 / n for k in range(n)}


def rolling(n: int) -> dict[int, float]:
    """The full convolution with n equal weights, places counted from the first it touches."""
    return {-k: 1 / n for k in range(n)}


def causal(width: int) -> dict[int, float]:
    """2 width - 1 equal weights of which the first half (rounded up) of ``width`` are 0."""
    zeros = math.ceil(width / 2)
    taps = [width - 1 - j for j in range(zeros, 2 * width - 1)]
    return {o: 1 / len(taps) for o in taps}


def centred(n: int) -> dict[int, float]:
    return {o: 1 / n for o in range(-(n // 2), n - n // 2)}


def gaussian(sigma: float, truncate: float = 4.0) -> dict[int, float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-r, r + 1)]
    return {o: x / sum(w) for o, x in zip(range(-r, r + 1), w)}


def decay(tau: float, least: float = 1e-7) -> dict[int, float]:
    """exp(-t/tau)/tau from t = 0, where it counts half, until it is less than ``least``."""
    taps = {0: 0.5 / tau}
    t = 1
    while math.exp(-t / tau) / tau >= least:
        taps[-t] = math.exp(-t / tau) / tau
        t += 1
    return taps


def lowpass(cutoff: float, rate: float, least: float = 1e-8) -> dict[int, float]:
    """The impulse response of a first-order Butterworth low-pass, until it is less than ``least``.

    Its memory fades, so the recursion is a convolution with few taps that need no order of execution.
    """
    k = math.tan(math.pi * cutoff / rate)
    b, a = k / (1 + k), (k - 1) / (k + 1)
    taps, h, t = {0: b}, b * (1 - a), 1
    while abs(h) >= least:
        taps[-t] = h
        h, t = -a * h, t + 1
    return taps


def hann_grid(df: DataFrame, keys: Sequence[str], n: int, rows: str = "by", cols: str = "bx", value: str = "value") -> DataFrame:
    """Grid values smoothed by a normalised two-dimensional Hann window, 0 beyond the grid's cells."""
    w = np.hanning(n)
    k = np.outer(w, w)
    k /= k.sum()
    taps = F.array(*[F.struct(F.lit(i - n // 2).alias("a"), F.lit(j - n // 2).alias("b"), F.lit(float(k[i, j])).alias("w")) for i in range(n) for j in range(n) if k[i, j] > 0])
    e = df.select(*keys, rows, cols, F.col(value).alias("v")).withColumn("tap", F.explode(taps))
    s = e.groupBy(*keys, (F.col(rows) + F.col("tap.a")).alias(rows), (F.col(cols) + F.col("tap.b")).alias(cols)).agg(F.sum(F.col("v") * F.col("tap.w")).alias("smooth"))
    return s.join(df.select(*keys, rows, cols).distinct(), [*keys, rows, cols], "left_semi")


def match_distribution(source: DataFrame, template: DataFrame, cell_rows: int = 20_000) -> DataFrame:
    """Give each source value the template's value at the same cumulative share, linear in between.

    source, template: ``value``. Running counts go by ranges of values, the matching by cells of the share that
    hold about ``cell_rows`` rows. Result: the distinct source values as ``value`` with their ``n`` and ``matched``;
    shares beyond the template's first and last take its first and last value. Null and NaN values take no part.
    """

    def shares(df: DataFrame) -> tuple[DataFrame, int]:
        c = df.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("value").agg(F.count("*").alias("n"))
        c = cut(running_total(c, "value", F.col("n"), "upto"), "shares")
        total = c.agg(F.max("upto")).first()[0] or 1
        return c.select("value", "n", F.lit(0).alias("g"), (F.col("upto") / total).alias("t")), total

    (s, n), (t, m) = shares(source), shares(template)
    t = t.select("g", "t", F.col("t").alias("q"), F.col("value").alias("v"))
    width = min(1.0, cell_rows / max(n, m))
    b = asof(s, t, ["g"], "t", ["q", "v"], width).withColumnsRenamed({"q": "q0", "v": "v0"})
    b = asof(b, t, ["g"], "t", ["q", "v"], width, forward=True)
    line = F.when(F.col("q0").isNull(), F.col("v")).when(F.col("q").isNull() | (F.col("q") == F.col("q0")), F.col("v0")).otherwise(F.col("v0") + (F.col("v") - F.col("v0")) * (F.col("t") - F.col("q0")) / (F.col("q") - F.col("q0")))
    return b.select("value", "n", line.alias("matched"))


def unwrapped_step(angle: Column, before: Column) -> Column:
    """The step from one angle to the next by the shorter way round."""
    d = angle - before
    return d - 2 * math.pi * F.round(d / (2 * math.pi))


def lowess(df: DataFrame, key: str, x: str, y: str, share: float = 1 / 3, points: int = 101) -> DataFrame:
    """Local straight-line regression with tricube weights at equally spaced points of each key's span.

    The weights reach over ``share`` of the span. Rows add their moments to the points they weigh on, batch by
    batch, and the sums are aggregated: no row ever meets another one. Result: key, ``point`` (from 0), ``x``,
    ``smooth`` (the weighted mean where the line is not determined) and ``weight``. Null and NaN take no part.
    """
    ok = df.filter(F.col(x).isNotNull() & ~F.isnan(x) & F.col(y).isNotNull() & ~F.isnan(y)).select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = ok.join(ok.groupBy(key).agg(F.min("x").alias("lo"), F.max("x").alias("hi")), key).filter("hi > lo")

    def moments(batches):
        grid = np.arange(points) / (points - 1)
        for pdf in batches:
            if not len(pdf):
                continue
            k, at = np.unique(pdf[key].to_numpy(), return_inverse=True)
            u = (pdf["x"].to_numpy() - pdf["lo"].to_numpy()) / (pdf["hi"].to_numpy() - pdf["lo"].to_numpy())
            v = pdf["y"].to_numpy()
            sums = np.zeros((len(k), points, 5))
            for i in range(0, len(u), 2048):
                d = (u[i : i + 2048, None] - grid) / share
                w = np.where(np.abs(d) < 1, (1 - np.abs(d) ** 3) ** 3, 0)
                part = np.stack([w, w * d, w * d * d, w * v[i : i + 2048, None], w * d * v[i : i + 2048, None]], axis=2)
                np.add.at(sums, at[i : i + 2048], part)
            r, p = np.nonzero(sums[:, :, 0])
            yield pd.DataFrame({key: k[r], "point": p.astype(np.int32), **{f"m{j}": sums[r, p, j] for j in range(5)}})

    kind = dict(df.dtypes)[key]
    m = rows.mapInPandas(moments, f"{key} {kind}, point int, m0 double, m1 double, m2 double, m3 double, m4 double").groupBy(key, "point").agg(*[F.sum(f"m{j}").alias(f"m{j}") for j in range(5)])
    m = m.join(rows.groupBy(key).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi")), key)
    det = F.col("m0") * F.col("m2") - F.col("m1") * F.col("m1")
    line = F.when(det > 1e-9 * F.col("m0") * F.col("m0"), (F.col("m2") * F.col("m3") - F.col("m1") * F.col("m4")) / det).otherwise(F.col("m3") / F.col("m0"))
    return m.select(key, "point", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)).alias("x"), line.alias("smooth"), F.col("m0").alias("weight"))
