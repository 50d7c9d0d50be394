"""Maps over cell positions: medians within a radius, sign maps, strips put side by side."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stimlake.tables import cut, maybe_broadcast


def select_cells(cells: DataFrame, *, without_planes: tuple[int, ...] = (0,), peaks: DataFrame | None = None, least_peak: float = 0.2) -> DataFrame:
    """The regions that are cells, outside the planes that only fly back, and with a field strong enough.

    cells: ``neuron, iscell, plane`` and any other columns; a null iscell or plane is none. peaks: ``neuron, peak``
    (without them all cells stay); a peak must be greater than least_peak. A repeated neuron counts once.
    """
    ok = cells.filter(F.col("neuron").isNotNull() & F.col("iscell") & F.col("plane").isNotNull() & ~F.col("plane").isin(*without_planes)).dropDuplicates(["neuron"])
    if peaks is None:
        return ok
    return ok.join(peaks.filter(F.col("peak") > least_peak).groupBy("neuron").agg(F.max("peak").alias("peak")), "neuron")


def radius_counts(points: DataFrame, centres: DataFrame, radius: float, n_values: int, *, group_rows: int = 20_000) -> DataFrame:
    """How often each of the values 0..n_values-1 occurs within a radius of each centre.

    points: ``y, x`` and the small integers ``vals`` ARRAY (one an axis); centres: ``id, y, x``. Result: ``id`` and
    ``counts``, an array of one array of counts for each axis. No pair is ever a row: points and centres meet in
    squares, and a block of distances is multiplied by the values' indicators. Points of one place with the same
    values are one point that counts so often; squares (eight radii wide) with more than ``group_rows`` of them are
    salted and their counts added up.
    """
    side = 8 * radius
    sq = lambda c: F.floor(F.col(c) / side)
    ok = "abs(y) < 1e12 AND abs(x) < 1e12"
    c = centres.filter(ok).select("id", "y", "x", sq("y").alias("gy"), sq("x").alias("gx"))
    # a point also goes to the neighbouring squares that it is within the radius of
    reach = lambda v: F.array_distinct(F.array(*[F.floor((F.col(v) + o) / side) for o in (-radius, 0, radius)]))
    p = points.filter(ok).filter("vals IS NOT NULL").select((F.col("y") + 0.0).alias("py"), (F.col("x") + 0.0).alias("px"), "vals").groupBy("py", "px", "vals").agg(F.count("*").alias("times"))
    p = p.withColumn("gy", F.explode(reach("py"))).withColumn("gx", F.explode(reach("px")))
    crowded = maybe_broadcast(cut(p.groupBy("gy", "gx").count().filter(F.col("count") > group_rows).select("gy", "gx", F.ceil(F.col("count") / group_rows).cast("int").alias("salts")), "crowded"))
    salts = F.coalesce(F.col("salts"), F.lit(1))
    p = p.join(crowded, ["gy", "gx"], "left").withColumn("salt", F.pmod(F.xxhash64("py", "px", "vals"), salts).cast("int")).drop("salts")
    c = c.join(crowded, ["gy", "gx"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")

    def run(pts: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(pts) or not len(cs):
            return pd.DataFrame({"id": [], "counts": pd.Series([], dtype=object)})
        vals = np.array(pts["vals"].tolist(), int)
        hot = np.concatenate([np.eye(n_values)[vals[:, a]] for a in range(vals.shape[1])], axis=1) * pts["times"].to_numpy()[:, None]
        y, x, cy, cx = (d[k].to_numpy() for d, k in ((pts, "py"), (pts, "px"), (cs, "y"), (cs, "x")))
        out = np.empty((len(cs), hot.shape[1]))
        for i in range(0, len(cs), 2048):
            out[i : i + 2048] = (np.hypot(cy[i : i + 2048, None] - y, cx[i : i + 2048, None] - x) <= radius).astype(float) @ hot
        some = out.any(1)
        return pd.DataFrame({"id": cs["id"].to_numpy()[some], "counts": pd.Series(list(out[some].astype(np.int64)), dtype=object)})

    keys = ["gy", "gx", "salt"]
    parts = p.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(run, "id long, counts array<long>")
    # one part for each salt of a centre's square
    zeros = F.transform(F.col("parts")[0], lambda n: F.lit(0).cast("long"))
    added = F.aggregate("parts", zeros, lambda x, y: F.zip_with(x, y, lambda a, b: a + b))
    return parts.groupBy("id").agg(F.collect_list("counts").alias("parts")).select("id", added.alias("counts"))


def median_of_counts(counts: str, axis: int, n_values: int):
    """The median of the values 0..n_values-1 that occur as often as counted, the mean of the middle two."""
    c = F.slice(F.col(counts), axis * n_values + 1, n_values)
    total = F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    upto = F.transform(F.sequence(F.lit(1), F.lit(n_values)), lambda k: F.aggregate(F.slice(c, 1, k), F.lit(0).cast("long"), lambda a, b: a + b))
    nth = lambda k: F.size(F.filter(upto, lambda u: u < k))
    return (nth(F.floor((total + 1) / 2)) + nth(F.floor(total / 2) + 1)) / 2


def smooth_positions(cells: DataFrame, radius: float, n_values: int) -> DataFrame:
    """Preferred places x and y of each cell replaced by the medians within the radius, halves cut off.

    cells: ``id, y, x`` (position) and ``pref_x, pref_y`` INT. Result: id, ``smooth_x, smooth_y``.
    """
    counts = radius_counts(cells.select("y", "x", F.array("pref_x", "pref_y").alias("vals")), cells, radius, n_values)
    return counts.select("id", median_of_counts("counts", 0, n_values).cast("int").alias("smooth_x"), median_of_counts("counts", 1, n_values).cast("int").alias("smooth_y"))


def preference_map(cells: DataFrame, pixel: float, radius: float, n_values: int) -> DataFrame:
    """Medians of the preferred places of the cells within a radius of each pixel: ``gy, gx, med_x, med_y``.

    The map spans the cells; pixels without a cell in reach have no row. Only pixels near occupied squares are ever
    made, each from those squares.
    """
    ok = cells.filter("abs(y) < 1e12 AND abs(x) < 1e12")
    at = lambda c: F.floor(F.col(c) / pixel)
    taken = ok.select(at("y").alias("gy"), at("x").alias("gx")).distinct()
    y0, y1, x0, x1 = taken.agg(F.min("gy"), F.max("gy"), F.min("gx"), F.max("gx")).first()
    if y0 is None:
        return cells.sparkSession.createDataFrame([], "gy long, gx long, med_x double, med_y double")
    k = math.ceil(radius / pixel)
    around = lambda c: F.explode(F.transform(F.sequence(F.lit(-k), F.lit(k + 1)), lambda d: F.col(c) + d)).alias(c)
    grid = taken.select(around("gy"), "gx").select("gy", around("gx")).distinct().filter(F.col("gy").between(y0, y1) & F.col("gx").between(x0, x1))
    half = 1 << 31
    centres = grid.select((F.shiftleft(F.col("gy"), 32) + F.col("gx") + half).alias("id"), (F.col("gy") * pixel).alias("y"), (F.col("gx") * pixel).alias("x"))
    c = radius_counts(ok.select("y", "x", F.array("pref_x", "pref_y").alias("vals")), centres, radius, n_values)
    gx = F.col("id").bitwiseAND(F.lit((1 << 32) - 1)) - half
    return c.select(F.shiftright("id", 32).alias("gy"), gx.alias("gx"), median_of_counts("counts", 0, n_values).alias("med_x"), median_of_counts("counts", 1, n_values).alias("med_y"))


def gradient(grid: DataFrame, value: str, along: str, across: str) -> DataFrame:
    """Central differences along an axis, one-sided at the ends: adds ``d_<value>_<along>``."""
    w = Window.partitionBy(across).orderBy(along)  # a line of a map: bounded by the map, not by the rows
    lo, hi = F.lag(value).over(w), F.lead(value).over(w)
    step = F.when(lo.isNull() & hi.isNull(), 0.0).when(lo.isNull(), hi - F.col(value)).when(hi.isNull(), F.col(value) - lo).otherwise((hi - lo) / 2)
    return grid.withColumn(f"d_{value}_{along}", step)


def sign_map(grid: DataFrame) -> DataFrame:
    """Sine of the angle between the gradients of two maps on a grid: gy, gx, ``sign``. grid: gy, gx, med_x, med_y."""
    g = grid
    for v in ("med_x", "med_y"):
        g = gradient(gradient(g, v, "gy", "gx"), v, "gx", "gy")
    angle = lambda v: F.atan2(f"d_{v}_gx", f"d_{v}_gy")
    return g.select("gy", "gx", F.sin(angle("med_x") - angle("med_y")).alias("sign"))


def unwrap_strips(cells: DataFrame, resolution: float) -> DataFrame:
    """Three strips that lie one above the other put side by side, in micrometres: id, ``uy, ux``."""
    y, x = cells.agg(F.max("y"), F.max("x")).first()
    ly, lx = math.ceil((y or 0) / 3), math.ceil(x or 0)
    k = F.when((F.col("y") > ly) & (F.col("y") <= 2 * ly), 1).when(F.col("y") > 2 * ly, 2).otherwise(0)
    return cells.select("id", ((F.col("y") - k * ly) * resolution).alias("uy"), ((F.col("x") + k * lx) * resolution).alias("ux"))
