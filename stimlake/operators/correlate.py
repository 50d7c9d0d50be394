"""Receptive fields: correlation of every neuron's response with every stimulus feature.

Both sides are cut into blocks of features, of neurons and of frames; every combination is one group with its
own matrix product, and the products of one pair of blocks are added up. No side is ever broadcast and no
pair of rows is ever formed. The long form (a join of features and responses by frame) is the plain definition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stimlake.tables import maybe_broadcast, parts


def _blocks(df: DataFrame, vec: str, size: int, name: str) -> DataFrame:
    """One row for each frame and block of the vector: frame, block, values."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(vec) / size) - 1, F.lit(0)).cast("int"))
    return df.filter(F.size(vec) > 0).select("frame", F.explode(F.transform(starts, lambda b: F.struct(b.alias(name), F.slice(F.col(vec), b * size + 1, size).alias("v")))).alias("z")).select(F.col("frame").cast("long").alias("frame_no"), f"z.{name}", "z.v").withColumnRenamed("frame_no", "frame")


def cross_correlation(features: DataFrame, responses: DataFrame, *, n_features: int, n_neurons: int, feature_block: int = 512, neuron_block: int = 512, frame_block: int = 1024, fold: int = 16) -> DataFrame:
    """Pearson r of all pairs: ``neuron, feature, r`` (both by their place in the vectors).

    features: ``frame, vec``; responses: ``frame, resp``; frames that both have count, each once. r is 0 where a
    side is constant. NaN and null elements are taken as 0. The products of a pair of blocks are added up ``fold``
    at a time until so many are left, so no task ever holds more of them, however long the movie is.
    """
    nf, nn = parts(n_features, feature_block), parts(n_neurons, neuron_block)
    x = _blocks(features.dropDuplicates(["frame"]), "vec", feature_block, "fb").withColumn("nb", F.explode(F.sequence(F.lit(0), F.lit(nn - 1))))
    y = _blocks(responses.dropDuplicates(["frame"]), "resp", neuron_block, "nb").withColumn("fb", F.explode(F.sequence(F.lit(0), F.lit(nf - 1))))
    first, last = responses.agg(F.min("frame"), F.max("frame")).first()
    spans = 0 if first is None else int(last // frame_block - first // frame_block + 1)
    tb = F.floor(F.col("frame") / frame_block).alias("tb")
    schema = "fb int, nb int, tb long, n long, sums array<double>"

    def product(xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        both = xs.merge(ys, on="frame", suffixes=("_x", "_y"))
        if not len(both):
            return pd.DataFrame({"fb": [], "nb": [], "tb": [], "n": [], "sums": pd.Series([], dtype=object)})
        a = np.nan_to_num(np.array(both["v_x"].tolist(), np.float64))
        b = np.nan_to_num(np.array(both["v_y"].tolist(), np.float64))
        sums = np.concatenate([a.sum(0), (a * a).sum(0), b.sum(0), (b * b).sum(0), (a.T @ b).ravel()])
        return pd.DataFrame({"fb": [xs["fb"].iloc[0]], "nb": [xs["nb"].iloc[0]], "tb": [both["frame"].iloc[0] // frame_block], "n": [len(both)], "sums": [sums]})

    keys = ["fb", "nb", tb]
    partial = x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInPandas(product, schema)

    def add(pdf: pd.DataFrame) -> np.ndarray:
        s = np.zeros(len(pdf["sums"].iloc[0]))
        for v in pdf["sums"]:
            s += v
        return s

    def some(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fb": [key[0]], "nb": [key[1]], "tb": [key[2]], "n": [pdf["n"].sum()], "sums": [add(pdf)]})

    while spans > fold:
        partial = partial.groupBy("fb", "nb", F.floor(F.col("tb") / fold).alias("tb")).applyInPandas(some, schema)
        spans = spans // fold + 2

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        fb, nb, n, s = pdf["fb"].iloc[0], pdf["nb"].iloc[0], pdf["n"].sum(), add(pdf)
        f = min(feature_block, n_features - fb * feature_block)
        k = min(neuron_block, n_neurons - nb * neuron_block)
        sx, sxx, sy, syy = s[:f], s[f : 2 * f], s[2 * f : 2 * f + k], s[2 * f + k : 2 * f + 2 * k]
        cov = s[2 * f + 2 * k :].reshape(f, k) - np.outer(sx, sy) / n
        vx, vy = np.maximum(sxx - sx * sx / n, 0), np.maximum(syy - sy * sy / n, 0)
        vx, vy = np.where(vx > 1e-12 * sxx, vx, 0), np.where(vy > 1e-12 * syy, vy, 0)
        d = np.sqrt(np.outer(vx, vy))
        r = np.where(d > 0, cov / np.where(d > 0, d, 1), 0.0)
        i, j = np.meshgrid(np.arange(f), np.arange(k), indexing="ij")
        return pd.DataFrame({"neuron": (nb * neuron_block + j).ravel(), "feature": (fb * feature_block + i).ravel(), "r": r.ravel()})

    return partial.groupBy("fb", "nb").applyInPandas(total, "neuron long, feature long, r double")


def long_correlation(features: DataFrame, responses: DataFrame) -> DataFrame:
    """The same from long tables (frame, feature, x) and (frame, neuron, y), by one join and one aggregation."""
    sx, sy = F.stddev_samp("x"), F.stddev_samp("y")
    r = F.when((sx == 0) | (sy == 0), 0.0).otherwise(F.covar_samp("x", "y") / (F.when(sx == 0, 1.0).otherwise(sx) * F.when(sy == 0, 1.0).otherwise(sy)))
    return features.join(responses, "frame").groupBy("neuron", "feature").agg(r.alias("r"))


def corrected(r: Column, absolute: bool = False) -> Column:
    """A correlation of at least 0.99 is a response to itself and loses 1; NaN and null count as 0."""
    r = F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0))
    r = F.abs(r) if absolute else r
    return F.when(r >= 0.99, r - 1).otherwise(r)


def peaks(field: DataFrame, ny: int, n_orient: int, n_size: int) -> DataFrame:
    """Each neuron's strongest feature by |r|, the lowest place among equals: ``neuron, x, y, o, s, peak``.

    field: neuron, feature (C-order of x, y, o, s) and r.
    """
    best = field.groupBy("neuron").agg(F.max_by(F.struct("feature", "r"), F.struct(F.abs("r"), -F.col("feature"))).alias("b"))
    i = F.col("b.feature")
    return best.select("neuron", *unravel(i, ny, n_orient, n_size), F.abs("b.r").alias("peak"))


def unravel(i: Column, ny: int, n_orient: int, n_size: int) -> list[Column]:
    """Places on the axes x, y, o, s of a flat C-order index."""
    return [F.floor(i / (ny * n_orient * n_size)).cast("int").alias("x"), F.pmod(F.floor(i / (n_orient * n_size)), F.lit(ny)).cast("int").alias("y"), F.pmod(F.floor(i / n_size), F.lit(n_orient)).cast("int").alias("o"), F.pmod(i, F.lit(n_size)).cast("int").alias("s")]


def array_peak(df: DataFrame, vec: str, ny: int, n_orient: int, n_size: int) -> DataFrame:
    """The same from whole fields as arrays, without exploding them."""
    clean = F.transform(vec, lambda e: F.abs(F.coalesce(F.when(~F.isnan(e), e.cast("double")), F.lit(0.0))))
    top = F.array_max("_a")
    return df.filter(F.size(vec) > 0).withColumn("_a", clean).select("neuron", *unravel((F.array_position("_a", top) - 1), ny, n_orient, n_size), top.alias("peak"))


def to_degrees(peaks_df: DataFrame, nx: int, ny: int, coverage: tuple[float, float, float, float], sigmas_deg: list[float], n_orient: int = 8) -> DataFrame:
    """Peak places as azimuth, elevation, orientation and size in degrees; coverage is (x0, x1, y0, y1)."""
    x0, x1, y0, y1 = coverage
    stretch = (abs(y1 - y0) / ny) / (abs(x1 - x0) / nx)
    angle = F.degrees(F.atan(stretch * F.tan(F.radians(F.col("o") * 180.0 / n_orient))))
    return peaks_df.withColumns({
        "azimuth": F.col("x") * abs(x0 - x1) / nx + x1,
        "elevation": F.abs(F.col("y") - ny) * abs(y1 - y0) / ny + y0,
        "orientation": F.when(angle < 0, angle + 180).otherwise(angle),
        "size": F.element_at(F.array(*[F.lit(float(v)) for v in sigmas_deg]), F.col("s") + 1),
    })


def strongest(field: DataFrame, top: int) -> DataFrame:
    """The ``top`` strongest features of each neuron, by |r| and then by place."""
    w = Window.partitionBy("neuron").orderBy(F.abs("r").desc(), "feature")
    return field.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def preferred_series(features: DataFrame, preferred: DataFrame) -> DataFrame:
    """The course of each neuron's preferred feature: ``neuron, frame, value``.

    features: ``frame, vec``; preferred: ``neuron, feature`` (its place in vec). Only the preferred features leave
    their frames; a feature beyond the vectors has no course.
    """
    wanted = preferred.select("neuron", F.col("feature").cast("int").alias("feature")).filter("neuron IS NOT NULL AND feature >= 0")
    e = features.filter("frame IS NOT NULL").dropDuplicates(["frame"]).select("frame", F.posexplode("vec").alias("feature", "value"))
    e = e.join(maybe_broadcast(wanted.select("feature").distinct()), "feature", "left_semi")
    return e.join(maybe_broadcast(wanted), "feature").select("neuron", "frame", "value")
