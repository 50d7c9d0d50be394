"""Tuning: binned responses, tuning volumes, spike-triggered statistics, preferred angles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stimlake.tables import spread


def polar(c: Column, s: Column) -> tuple[Column, Column]:
    """Radius, and angle in [0, 2 pi)."""
    phi = F.atan2(s, c)
    return F.sqrt(c * c + s * s), F.when(phi < 0, phi + 2 * math.pi).otherwise(phi)


def bin_of(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Bin 0..n-1 of equal bins over [lo, hi], the last one closed; null outside, and 0 where lo = hi."""
    b = F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * n), F.lit(n - 1))).otherwise(F.lit(0))
    return F.when((v >= lo) & (v <= hi), b.cast("int"))


def binned_mean(df: DataFrame, keys: Sequence[str], axes: dict[str, tuple[str, int]], value: str) -> DataFrame:
    """Mean of ``value`` in the cells of a grid over the axes' own spans: keys, one bin column an axis, mean, n.

    axes: name of the bin column -> (column, number of bins). Rows with null or NaN coordinates are left out.
    """
    ok = [F.col(c).isNotNull() & ~F.isnan(c) for c, _ in axes.values()]
    rows = df
    for o in ok:
        rows = rows.filter(o)
    spans = rows.groupBy(*keys).agg(*[f(c).alias(f"{n}_{e}") for n, (c, _) in axes.items() for e, f in (("lo", F.min), ("hi", F.max))])
    rows = rows.join(spans, list(keys))
    cells = [bin_of(F.col(c), F.col(f"{n}_lo"), F.col(f"{n}_hi"), k).alias(n) for n, (c, k) in axes.items()]
    return rows.groupBy(*keys, *cells).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def tuning_volume(df: DataFrame, keys: Sequence[str], trial: str, limit: float, bins: int = 20) -> DataFrame:
    """Mean response by radius, angle and change of angle.

    df: keys, trial, ``rho, phi, dphi`` and the weight ``w``. Bins run over [0, max rho], [0, max phi] and
    [-limit, limit]; rows outside are left out. Weighted and plain counts of each trial are averaged over the
    trials, ``mean`` is their ratio.
    """
    top = df.groupBy(*keys).agg(F.max("rho").alias("rho_hi"), F.max("phi").alias("phi_hi"), F.count_distinct(trial).alias("trials"))
    z = F.lit(0.0)
    rows = df.join(top, list(keys)).select(*keys, "trials", "w", bin_of(F.col("rho"), z, F.col("rho_hi"), bins).alias("b_rho"), bin_of(F.col("phi"), z, F.col("phi_hi"), bins).alias("b_phi"), bin_of(F.col("dphi"), F.lit(-limit), F.lit(limit), bins).alias("b_dphi"))
    g = rows.dropna(subset=["b_rho", "b_phi", "b_dphi"]).groupBy(*keys, "b_rho", "b_phi", "b_dphi").agg((F.sum("w") / F.first("trials")).alias("weighted"), (F.count("*") / F.first("trials")).alias("count"))
    return g.withColumn("mean", F.col("weighted") / F.col("count"))


def lagged(df: DataFrame, keys: Sequence[str], value: str, lags: Sequence[int]) -> DataFrame:
    """``lag_k`` of a dense series (index ``i``): the value k places before; null before the beginning."""
    tap = F.explode(F.array(*[F.lit(int(k)) for k in lags]))
    moved = df.select(*keys, "i", value).withColumn("k", tap).withColumn("i", F.col("i") + F.col("k"))
    wide = moved.groupBy(*keys, "i").agg(*[F.max(F.when(F.col("k") == k, F.col(value))).alias(f"lag_{k}") for k in lags])
    return df.join(wide, [*keys, "i"], "left")


def moved(df: DataFrame, keys: Sequence[str], value: str, places: int, fill: float = 0.0) -> DataFrame:
    """``moved`` of a dense series (index ``i``): the value ``places`` further on (before, if negative), ``fill`` beyond the ends."""
    other = df.select(*keys, (F.col("i") - places).alias("i"), F.col(value).alias("moved"))
    return df.join(other, [*keys, "i"], "left").withColumn("moved", F.coalesce("moved", F.lit(fill)))


def triggered_average(df: DataFrame, keys: Sequence[str], weight: str, value: str, n_lags: int) -> DataFrame:
    """Spike-triggered average: for each lag the mean of the value that many places before, weighted.

    The first n_lags places do not count, so every lag uses the same ones. Result: keys, ``lag``, ``sta``.
    """
    w = lagged(df, keys, value, range(n_lags)).filter(F.col("i") >= n_lags)
    total = F.sum(weight)
    a = w.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(weight) * F.col(f"lag_{k}")), total).alias(str(k)) for k in range(n_lags)])
    return a.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(str(k)).alias("sta")) for k in range(n_lags)])).alias("z")).select(*keys, "z.lag", "z.sta")


def triggered_covariance(df: DataFrame, keys: Sequence[str], weight: str, a: str, b: str, n_lags: int) -> DataFrame:
    """Spike-triggered covariance of two series at all pairs of lags: keys, ``lag_a, lag_b, stc``.

    The triggered averages are subtracted through sums of products, so one pass suffices.
    """
    both = lagged(lagged(df, keys, a, range(n_lags)).withColumnsRenamed({f"lag_{k}": f"a_{k}" for k in range(n_lags)}), keys, b, range(n_lags)).filter(F.col("i") >= n_lags)
    w = F.col(weight)
    sums = [F.sum(w).alias("w")] + [F.sum(w * F.col(f"a_{k}")).alias(f"sa_{k}") for k in range(n_lags)] + [F.sum(w * F.col(f"lag_{k}")).alias(f"sb_{k}") for k in range(n_lags)]
    sums += [F.sum(w * F.col(f"a_{i}") * F.col(f"lag_{j}")).alias(f"sab_{i}_{j}") for i in range(n_lags) for j in range(n_lags)]
    g = both.groupBy(*keys).agg(*sums)
    cell = lambda i, j: F.try_divide(F.col(f"sab_{i}_{j}"), F.col("w")) - F.try_divide(F.col(f"sa_{i}"), F.col("w")) * F.try_divide(F.col(f"sb_{j}"), F.col("w"))
    return g.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("lag_a"), F.lit(j).alias("lag_b"), cell(i, j).alias("stc")) for i in range(n_lags) for j in range(n_lags)])).alias("z")).select(*keys, "z.*")


def circular_variance(df: DataFrame, keys: Sequence[str], angle_deg: str, response: str) -> DataFrame:
    """Preferred orientation (0..180) and circular variance of responses to orientations.

    Both are null where the responses add up to 0.
    """
    t = F.radians(F.col(angle_deg)) * 2
    g = df.groupBy(*keys).agg(F.sum(F.col(response) * F.cos(t)).alias("c"), F.sum(F.col(response) * F.sin(t)).alias("s"), F.sum(response).alias("r"))
    re, im = F.try_divide("c", "r"), F.try_divide("s", "r")
    return g.select(*keys, F.pmod(F.degrees(F.atan2(im, re)) / 2 + 180, F.lit(180.0)).alias("preferred"), (1 - F.sqrt(re * re + im * im)).alias("variance"))


def rank_one(volumes: DataFrame, key: str, shape: tuple[int, int, int], iterations: int = 60) -> DataFrame:
    """Rank-one non-negative factors of each key's volume.

    volumes: key, ``cells`` ARRAY in C-order of the shape (a volume has a fixed number of cells, whatever the
    number of rows behind it). Null and NaN cells take the value of the nearest known cell. Alternating least
    squares from the sums along the axes, so the result is the same every time. Result: key, ``f0, f1, f2`` (each
    of length 1 but the first) and ``error``, the share of the squares left.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for k, c in zip(pdf[key], pdf["cells"]):
                v = fill_nearest(np.array([np.nan if x is None else x for x in c], float).reshape(shape))
                a, b, g, left = factors(v, iterations)
                rows.append((k, a, b, g, left))
            yield pd.DataFrame(rows, columns=[key, "f0", "f1", "f2", "error"])

    kind = dict(volumes.dtypes)[key]
    return spread(volumes.select(key, "cells"), key).mapInPandas(run, f"{key} {kind}, f0 array<double>, f1 array<double>, f2 array<double>, error double")


def fill_nearest(v: np.ndarray) -> np.ndarray:
    """NaN cells take the value of the nearest known cell, the first in C-order of several."""
    hole = np.isnan(v)
    if hole.all():
        return np.zeros_like(v)
    if hole.any():
        known, at = np.argwhere(~hole), np.argwhere(hole)
        v = v.copy()
        for i in range(0, len(at), 512):
            d = ((at[i : i + 512, None] - known[None]) ** 2).sum(-1)
            v[tuple(at[i : i + 512].T)] = v[tuple(known[d.argmin(1)].T)]
    return v


def rank_two_marginals(fields: DataFrame, vec: str, nx: int, ny: int, rest: int) -> DataFrame:
    """Singular vectors of each field's x-y map (its mean over the other axes): neuron, ``su, sv, values``.

    The sign is such that each first vector's largest element is positive.
    """

    def run(batches):
        for pdf in batches:
            m = np.nan_to_num(np.array(pdf[vec].tolist(), np.float64)).reshape(-1, nx, ny, rest).mean(-1)
            u, s, vt = np.linalg.svd(m, full_matrices=False)
            u0, v0 = u[:, :, 0], vt[:, 0, :]
            sign = np.sign(np.take_along_axis(u0, np.abs(u0).argmax(1)[:, None], 1))
            sign[sign == 0] = 1
            yield pd.DataFrame({"neuron": pdf["neuron"], "su": list(u0 * sign), "sv": list(v0 * sign), "values": list(s)})

    return fields.filter(F.size(vec) == nx * ny * rest).select("neuron", vec).mapInPandas(run, "neuron long, su array<double>, sv array<double>, values array<double>")


def hann_volume(v: np.ndarray, n: int, circular: int | None = 1) -> np.ndarray:
    """A batch of volumes smoothed by a normalised Hann window of n bins along each axis; 0 beyond the ends, or going
    round along the circular axis."""
    w = np.hanning(n + 2)[1:-1] if n < 3 else np.hanning(n)
    w = w / w.sum()
    for axis in (1, 2, 3):
        pad = [(0, 0)] * 4
        pad[axis] = (n // 2, n // 2)
        p = np.pad(v, pad, mode="wrap" if circular is not None and axis == circular + 1 else "constant")
        v = sum(w[i] * np.take(p, range(i, i + v.shape[axis]), axis=axis) for i in range(n))
    return v


def tuning_curves(volume: DataFrame, key: str, bins: int, limit: float, smooth: int = 5) -> DataFrame:
    """What the tuning volume of each key says: the curves over radius, angle and step, and their indices.

    volume: the result of tuning_volume. Numerator and denominator are smoothed apart, the angle going round;
    cells without data take the nearest value; a rank-one factorisation gives ``f_rho, f_phi, f_dphi``. With
    ``drift`` (the step at the curve's top), ``half_rho`` (the first radius bin, as a share of the greatest radius,
    at which the curve has half its top) and ``complexity`` (1 less the circular variance over the angle).
    """
    n = bins**3
    at = F.col("b_rho") * bins * bins + F.col("b_phi") * bins + F.col("b_dphi")
    rows = volume.groupBy(key).agg(F.collect_list(F.struct(at.alias("i"), "weighted", "count")).alias("cells"))

    def run(batches):
        for pdf in batches:
            num, den = np.zeros((2, len(pdf), n))
            for r, cells in enumerate(pdf["cells"]):
                i = [c["i"] for c in cells]
                num[r, i], den[r, i] = [c["weighted"] for c in cells], [c["count"] for c in cells]
            num, den = (hann_volume(x.reshape(-1, bins, bins, bins), smooth) for x in (num, den))
            with np.errstate(all="ignore"):
                ratio = np.where(den > 1e-12, num / den, np.nan)
            out = []
            for k, v in zip(pdf[key], ratio):
                a, b, g, _ = factors(fill_nearest(v))
                angle = np.exp(2j * np.pi * (np.arange(bins) + 0.5) / bins)
                top = a.max()
                out.append((k, a, b, g, float((g.argmax() + 0.5) / bins * 2 * limit - limit), float((np.argmax(a >= top / 2) + 0.5) / bins), float(abs((b * angle).sum()) / max(b.sum(), 1e-300))))
            yield pd.DataFrame(out, columns=[key, "f_rho", "f_phi", "f_dphi", "drift", "half_rho", "complexity"])

    kind = dict(volume.dtypes)[key]
    return spread(rows, key).mapInPandas(run, f"{key} {kind}, f_rho array<double>, f_phi array<double>, f_dphi array<double>, drift double, half_rho double, complexity double")


def factors(v: np.ndarray, iterations: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Rank-one non-negative factors of a volume (the last two of length 1) and the share of the squares left."""
    a, b, g = (np.maximum(v.sum(x), 0) for x in ((1, 2), (0, 2), (0, 1)))
    for _ in range(iterations):
        b = np.maximum(np.einsum("ijk,i,k->j", v, a, g), 0)
        b /= max(np.linalg.norm(b), 1e-300)
        g = np.maximum(np.einsum("ijk,i,j->k", v, a, b), 0)
        g /= max(np.linalg.norm(g), 1e-300)
        a = np.maximum(np.einsum("ijk,j,k->i", v, b, g), 0)
    left = ((v - np.einsum("i,j,k->ijk", a, b, g)) ** 2).sum() / max((v**2).sum(), 1e-300)
    return a, b, g, float(left)


def predict_from_curves(df: DataFrame, curves: DataFrame, tops: DataFrame, keys: Sequence[str], bins: int, limit: float) -> DataFrame:
    """``pred`` of each row with ``rho, phi, dphi``: the product of its key's curves at the row's bins.

    tops: the keys with the greatest radius and angle (``rho_hi, phi_hi``) the bins go up to; rows beyond a bin's
    span take the nearest bin.
    """
    j = df.join(tops, list(keys)).join(curves.select(*keys, "f_rho", "f_phi", "f_dphi"), list(keys))
    place = lambda v, lo, hi: F.least(F.greatest(F.coalesce(F.floor(F.try_divide((v - lo) * bins, hi - lo)), F.lit(0)), F.lit(0)), F.lit(bins - 1)).cast("int")
    cell = lambda f, v, lo, hi: F.get(f, place(F.col(v), lo, hi))
    z = F.lit(0.0)
    pred = cell("f_rho", "rho", z, F.col("rho_hi")) * cell("f_phi", "phi", z, F.col("phi_hi")) * cell("f_dphi", "dphi", F.lit(-limit), F.lit(limit))
    return j.withColumn("pred", pred).drop("rho_hi", "phi_hi", "f_rho", "f_phi", "f_dphi")
